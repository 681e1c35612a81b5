"""Many rows of one id: line counts, and the bounds of the toxicity sample."""

import compare
import pytest
from paperloom.llm import linededup, toxicity
from paperloom.llm.oracle import ORACLE
from pyspark.sql import functions as F

LINE = "a line of more than forty characters that many documents hold"


@pytest.mark.parametrize("others, dropped", [(1, 0), (3, 0), (4, 5)])
def test_lines_count_documents_not_rows(spark, tmp_path, others, dropped):
    rows = [(1, f"{LINE}\nown {k}") for k in range(4)] + [(2 + k, f"x\n  {LINE.upper()} ") for k in range(others)] + [(None, LINE)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped").collect()
    assert sum(r["n_dropped"] for r in got if r["doc_id"] is not None and r["doc_id"] != 1 + others) == (dropped and 4 + others - 1)
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    named.write.parquet(str(tmp_path / "documents.parquet"))
    con = compare.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE["op9_line_dedup"]).df()
    kept = linededup.dedup_lines(named)
    assert compare.differences(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")).toPandas(), want) is None


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 30)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 60)
    rows = [(3, f"nasty words {k % 40} zap" if k % 2 else "nasty zap zap") for k in range(2000)] + [(k, f"clean text {k}") for k in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), *[(k, 0) for k in range(10, 400)]], "doc_id long, toxic int")
    sizes, real = [], toxicity._hashes
    monkeypatch.setattr(toxicity, "_hashes", lambda df: sizes.append(len(found := real(df))) or found)
    toxicity.train(docs, labels, fold=1, held=5)
    assert sizes == [30, 60]
    chosen = toxicity._at_most(docs, 25).collect()
    assert len(chosen) == 25 and sorted(map(str, chosen)) == sorted(map(str, toxicity._at_most(docs.repartition(7), 25).collect()))
    assert toxicity._at_most(docs.limit(0), 5).count() == 0 and toxicity._at_most(docs.limit(3), 5).count() == 3
