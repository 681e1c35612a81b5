"""The mix of rows that share an id, and the pipeline's stages after the near copies."""

import collections

import corpus_pipeline
import pytest
from paperloom.llm import decontaminate, mixing, shards
from paperloom.llm.common import settle, table
from test_text_operators import DOCS


def rows(df):
    return [r.asDict() for r in df.collect()]


def shared(spark):
    """A third NULL ids, a third one id, a third unique; three sources, of unlike sizes, whose draws differ."""
    made = []
    for i in range(600):
        source = "abc"[i // 3 % 3]
        text = f"t{i} " + "w " * (i % 7 + 20 * (source == "b"))
        made.append(((None, 5, 1000 + i)[i % 3], text, "en", source, 1, None, None))
    return spark.createDataFrame(made, DOCS)


@pytest.mark.parametrize("block", [4096, 20])
def test_each_row_gets_its_own_draw(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = shared(spark)
    want, got, times = collections.Counter(), collections.Counter(), collections.Counter()
    drawn = rows(mixing.mix(docs))
    assert len({r["row"] for r in drawn}) == len(drawn) == 600
    target = {r["source"]: r["target"] for r in drawn}
    taken = collections.Counter()
    for r in drawn:
        taken[r["source"]] += r["taken"]
    for r in rows(docs):
        want[r["source"]] += len(r["text"].split())
    for r in rows(mixing.apply_mix(docs)):
        got[r["source"]] += len(r["text"].split())
        times[r["source"], r["text"]] += 1
    for s, t in target.items():
        assert got[s] == taken[s] and abs(got[s] - t) <= 11  # half of the smallest text of b
    for (s, _), n in times.items():
        assert n <= int(target[s] / want[s]) + 1  # never the draw of a row of another source


def test_no_group_by_id(spark):
    plan = mixing.apply_mix(shared(spark))._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_equal_rows_fill_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    most = []
    flights = mixing._fly_blocks

    def seen(dealt, seed):
        block = mixing.F.pmod(mixing.F.xxhash64(mixing.F.lit(seed), "doc_id", "size", "salt"), mixing.F.col("blocks"))
        most.append(dealt.groupBy("code", block).count().agg({"count": "max"}).first()[0])
        return flights(dealt, seed)

    monkeypatch.setattr(mixing, "_fly_blocks", seen)
    docs = spark.createDataFrame([(None, "a b c", "en", "abc"[i % 3], 1, None, None) for i in range(900)], DOCS)
    assert sum(r["taken"] for r in rows(mixing.mix(docs))) > 0
    assert most[0] < 100


def test_stages_after_the_near_copies(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf, "documents")
    out = settle(stages["benchmark"](spark, docs, sf), "test")
    hit = {r["doc_id"] for r in rows(decontaminate.edit_matches(docs, table(spark, sf, "benchmark")))}
    assert hit and {r["doc_id"] for r in rows(out)} == {r["doc_id"] for r in rows(docs)} - hit

    docs, out = out, settle(stages["mix"](spark, out, sf), "test")
    want = collections.Counter({r["doc_id"]: r["copies"] for r in rows(mixing.mix(docs))})
    assert out.columns == docs.columns and collections.Counter(r["doc_id"] for r in rows(out)) == +want

    docs, out = out, stages["shards"](spark, out, sf)
    found = rows(out)
    assert len(found) == docs.count() and {r["shard"] for r in found} == set(range(16))
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((r["doc_id"], r["size"]) for r in rows(shards.sized(docs)))
