"""The corpus pipeline, stage by stage, against what each operator says of its input."""

import collections

import corpus_pipeline
from paperloom.llm import decontaminate, mixing, shards, toxicity
from paperloom.llm.common import settle, table
from test_near_copies import slow_components


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_each_stage_acts_on_its_input(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "benchmark", "mix", "shards"]

    out = settle(stages["toxicity"](spark, docs, sf), "test")
    kept = {r["doc_id"] for r in rows(toxicity.toxicity(docs, table(spark, sf, "labels"))) if not r["predicted"]}
    assert out.columns == columns and {r["doc_id"] for r in rows(out)} == kept

    docs, out = out, settle(stages["near_copies"](spark, out, sf), "test")
    kept = set(slow_components([(r["doc_id"], r["text"]) for r in rows(docs)]).values())  # Jaccard similarity of all pairs
    assert out.columns == columns and sorted(r["doc_id"] for r in rows(out)) == sorted(kept)

    docs, out = out, settle(stages["benchmark"](spark, out, sf), "test")
    hit = {r["doc_id"] for r in rows(decontaminate.edit_matches(docs, table(spark, sf, "benchmark")))}
    assert hit and {r["doc_id"] for r in rows(out)} == {r["doc_id"] for r in rows(docs)} - hit

    docs, out = out, settle(stages["mix"](spark, out, sf), "test")
    want = collections.Counter({r["doc_id"]: r["copies"] for r in rows(mixing.mix(docs))})
    assert out.columns == columns and collections.Counter(r["doc_id"] for r in rows(out)) == +want

    docs, out = out, stages["shards"](spark, out, sf)
    found = rows(out)
    assert len(found) == docs.count() and {r["shard"] for r in found} == set(range(16))
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((r["doc_id"], r["size"]) for r in rows(shards.sized(docs)))
