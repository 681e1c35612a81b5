"""Batches that count once, and ingest that reads new content only."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from paperloom.plans import derived
from paperloom.sources import commits, ledger, sinks

ROWS = "doc_id long, document_type string, attempt string"


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc_id long, document_type string")
    two = spark.createDataFrame([(3, "2024-01-01")], "doc_id long, document_type string")
    assert ids(commits.read_table(spark, path, one.schema)) == []
    with pytest.raises(ValueError):
        commits.read_table(spark, path)
    assert commits.write_batch(one, path, "one", ("document_type",))
    assert not commits.write_batch(one, path, "one", ("document_type",))
    assert commits.write_batch(two, path, "two", ("document_type",))
    lost = commits.write_attempt(two, path, ("document_type",))  # a job that died before its commit
    got = commits.read_table(spark, path)
    assert ids(got) == [1, 2, 2, 3] and got.schema.simpleString() == one.schema.simpleString()
    assert {r["document_type"] for r in got.collect()} == {"a", None, "2024-01-01"}  # not read as a date
    again = commits.write_attempt(one, path, ("document_type",))  # two writers commit one batch
    commits.commit(spark, path, "one", again, one.schema)
    assert ids(commits.read_table(spark, path)) == [1, 2, 2, 3]
    assert lost not in {r["attempt"] for r in commits.commits(spark, path).collect()}


def test_only_committed_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.write_batch(spark.range(5).withColumnRenamed("id", "doc_id"), path, "x")
    got = commits.read_table(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and got.count() == 5


def test_sinks_take_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "invoice"), (2, "memo")], "doc_id long, document_type string")
    for _ in range(2):
        sinks.write_results(rows, str(tmp_path / "r"), batch="b")
        sinks.append_decisions(rows, str(tmp_path / "d"), "s1", batch="b")
    assert ids(commits.read_table(spark, str(tmp_path / "r"))) == [1, 2]
    got = commits.read_table(spark, str(tmp_path / "d"))
    assert ids(got) == [1, 2] and {r["session_id"] for r in got.collect()} == {"s1"}


def test_stream_that_starts_again_adds_nothing_twice(spark, tmp_path):
    source, path, progress = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "p")
    spark.range(4).withColumnRenamed("id", "doc_id").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long").parquet(str(source))
    commits.start(stream, "first", path, progress).awaitTermination()
    # The last batch is done again: its progress is lost, its commit is not.
    for kind in ("commits", "offsets"):
        for name in sorted(os.listdir(f"{progress}/{kind}")):
            if kind == "commits" and (name == "0" or name.startswith(".0")):
                os.remove(f"{progress}/{kind}/{name}")
    commits.start(stream, "second", path, progress).awaitTermination()
    assert ids(commits.read_table(spark, path)) == [0, 1, 2, 3]
    spark.range(4, 6).withColumnRenamed("id", "doc_id").write.mode("append").parquet(str(source))
    commits.start(stream, "third", path, progress).awaitTermination()
    assert ids(commits.read_table(spark, path)) == [0, 1, 2, 3, 4, 5]


def test_filter_never_clears_a_known_key(spark):
    known = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    asked = spark.range(10000, 60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    bloom, blocks = ledger.bloom_filter(known, "k", 20000)
    assert blocks == 10 and bloom.count() == 10
    got = ledger.maybe_known(asked, "k", bloom, blocks).groupBy((F.col("id") < 20000).alias("known")).agg(F.count_if("_maybe").alias("maybe"), F.count("*").alias("n"))
    got = {r["known"]: (r["maybe"], r["n"]) for r in got.collect()}
    assert got[True] == (10000, 10000) and got[False][0] < 400  # about 0.3 % false positives


@pytest.mark.parametrize("bits", [1, 16])
def test_false_positives_change_nothing(spark, bits):
    known = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    rows = [(str(i % 4000), i, "clash") for i in range(2000, 9000)] + [(None, -1, "x"), ("9999", 7, "x"), ("9999", 6, None)]
    asked = spark.createDataFrame(rows, "k string, place long, block string")
    got = {(r["k"], r["place"], r["block"]) for r in ledger.new_rows(asked, known, "k", "place", bits_a_key=bits).collect()}
    want = {}
    for k, place, block in rows:
        if k is not None and int(k) >= 3000:
            want[k] = min(want.get(k, (place, block)), (place, block), key=lambda x: x[0])
    assert got == {(k, *v) for k, v in want.items()}
    assert ledger.new_rows(asked.limit(0), known, "k", "place").count() == 0
    assert ledger.new_rows(asked, known.limit(0), "k", "place").count() == len({k for k, _, _ in rows if k is not None})


def test_second_run_opens_new_files_only(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "ledger")
    (folder / "sub").mkdir(parents=True)
    for name, content in (("a.txt", "one"), ("b.txt", "two"), ("copy.txt", "one"), ("bad.docx", "x")):
        (folder / name).write_text(content)

    def run(batch):
        return {r["file_name"]: r for r in ledger.ingest_new(spark, str(folder), path, batch).collect()}

    first = run("r1")
    assert set(first) == {"a.txt", "b.txt", "bad.docx"} and first["a.txt"]["text"] == "one"
    assert first["a.txt"]["source_hash"] == hashlib.sha256(b"one").hexdigest() and first["bad.docx"]["load_error"]
    assert ledger.unseen_files(spark, str(folder), path).count() == 0 and run("r2") == {}
    (folder / "sub" / "c.txt").write_text("three")
    (folder / "sub" / "again.txt").write_text("two")  # known content at a new place
    time.sleep(1.1)
    (folder / "a.txt").write_text("four")  # a file that changed
    assert {r["path"].rsplit("/", 1)[1] for r in ledger.unseen_files(spark, str(folder), path).collect()} == {"c.txt", "again.txt", "a.txt"}
    third = run("r3")
    assert {k: v["text"] for k, v in third.items()} == {"c.txt": "three", "a.txt": "four"}
    (folder / "d.txt").write_text("five")
    assert run("r3") == {}  # the name of a run that is committed
    assert set(run("r4")) == {"d.txt"}
    assert ledger.entries(spark, path).count() == 8


def test_pages_are_files_and_folders_share_tasks(spark, tmp_path):
    rows = [(k, f"<p>{k % 150}\r\né</p>") for k in range(200)] + [(200, None), (201, "a"), (201, "b")]
    derived.write_pages(spark.createDataFrame(rows, "page_id long, html string"), f"file:{tmp_path}/in")
    written = {p.parent.name: p.read_bytes().decode() for p in (tmp_path / "in").rglob("*.txt")}
    assert written.pop("page_id=201") in ("a\nb\n", "b\na\n")
    assert written == {f"page_id={k}": (html or "") + "\n" for k, html in rows if k < 201}
    name, tracker = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.statusTracker()
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("scan", "scan")
    got = ledger.ingest_new(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), "one")
    spark.sparkContext._jsc.sc().clearJobGroup()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("scan") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= ledger.LISTING_TASKS + 8
    assert spark.conf.get(name) == before and got.count() == 152 and ledger.entries(spark, str(tmp_path / "ledger")).count() == 202


def test_tasks_list_and_read_what_spark_does(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "ledger")
    names = ["a.txt", "empty.txt", "two words%20.md", "d\u00e9j\u00e0.txt", "deep/er/x.csv", "_k=1/y.txt", "_metadata", "_metadata_of/m.txt", "deep/_hidden/z.txt", "_no.txt", ".no.txt", ".no/z.txt", "w.txt._COPYING_"]
    for k, name in enumerate(names):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"" if name == "empty.txt" else f"{k} caf\u00e9\r\n".encode() * (k + 1))
    (folder / "nothing").mkdir()
    (tmp_path / "aside").mkdir()
    (tmp_path / "aside" / "q.txt").write_text("q")
    (folder / "link").symlink_to(tmp_path / "aside")
    (folder / "broken.txt").symlink_to(tmp_path / "nowhere")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    want = {tuple(r) for r in reader.load(str(folder)).select("path", "modificationTime", "length", "content").collect()}
    assert len(want) == 7
    unseen = ledger.unseen_files(spark, f"file:{folder}", path)
    assert {tuple(r) for r in unseen.select("path", "modificationTime", "length").collect()} == {r[:3] for r in want}
    monkeypatch.setattr(ledger, "BATCH_BYTES", 64)
    assert {tuple(r) for r in ledger._opened(unseen, 2, None).collect()} == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ledger.unseen_files(spark, str(tmp_path / "nowhere"), path)

    def run(place, **options):
        rows = ledger.ingest_new(spark, str(folder), str(tmp_path / place), "one", **options).collect()
        return sorted((r["file_path"], r["file_size_bytes"], r["source_hash"] or "", r["text"] or "", r["load_error"] or "") for r in rows)

    (folder / "big.txt").write_bytes(b"x" * (1024 * 1024 + 1))
    found = [run("by tasks"), run("by tasks, less", max_mb=1)]
    assert "File too large: 1.00MB (max: 1MB)" in {r[4] for r in found[1]}
    monkeypatch.setattr(ledger, "_mounted", lambda *_: None)
    assert found == [run("by Spark"), run("by Spark, less", max_mb=1)]


def test_names_of_files_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    rows = [(k, f"<p>{k}</p>") for k in range(300)]
    derived.write_pages(spark.createDataFrame(rows, "page_id long, html string"), f"file:{tmp_path}/in")

    frame = type(spark.range(1))
    collect, most = frame.collect, []

    def gone(*_):
        raise AssertionError("names of files in the driver")

    def counted(df):
        rows = collect(df)
        most.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "toLocalIterator", gone)
    monkeypatch.setattr(frame, "collect", counted)
    monkeypatch.setattr(type(spark.read), "load", gone)
    got = ledger.ingest_new(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), "one")
    plan = ledger.unseen_files(spark, str(tmp_path / "in"), str(tmp_path / "ledger"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [path" not in plan
    assert max(most) <= 1 and got.count() == 300 and ledger.entries(spark, str(tmp_path / "ledger")).count() == 300
