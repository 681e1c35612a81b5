import hashlib

from pyspark.sql import functions as F

import paperloom
from paperloom.operators.trace import decision_rows
from paperloom.sources import files, sinks
from paperloom.streaming import documents as stream


def make_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.TXT").write_bytes("Mail a@b.com\r\nné\rend".encode())
    (folder / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.png").write_bytes(b"\x89PNG")
    (folder / "e.docx").write_bytes(b"x")
    (folder / "noext").write_bytes(b"x")
    (folder / "big.txt").write_bytes(b"x" * (1024 * 1024 + 1))
    (folder / "fits.txt").write_bytes(b"x" * (1024 * 1024))
    return folder


def test_ingest(spark, tmp_path):
    folder = make_folder(tmp_path)
    docs = files.ingest(files.scan(spark, str(folder), max_mb=1))
    got = {r.file_name: r for r in docs.collect()}
    assert len(got) == 8
    a = got["a.TXT"]
    assert (a.file_type, a.text, a.load_error) == ("txt", "Mail a@b.com\nné\nend", None)
    assert a.source_hash == hashlib.sha256((folder / "a.TXT").read_bytes()).hexdigest()
    assert a.file_size_bytes == (folder / "a.TXT").stat().st_size
    assert got["b.md"].text == "café"
    assert got["d.png"].text == "[Image content - OCR not available]"
    assert got["e.docx"].load_error == "Unsupported file type: docx"
    assert got["noext"].load_error == "Unsupported file type: "
    assert got["big.txt"].load_error == "File too large: 1.00MB (max: 1MB)"
    assert got["big.txt"].file_size_bytes == 0 and got["fits.txt"].load_error is None
    assert got["c.pdf"].load_error.startswith("Failed to load PDF")


def test_large_files_are_not_read(spark, tmp_path):
    plan = files.scan(spark, str(make_folder(tmp_path)), max_mb=1)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "LessThanOrEqual(length," in text and "GreaterThan(length," in text
    assert text.count("content#") and "ReadSchema: struct<path:string,modificationTime" in text


def test_missing_paths_and_failed_loads_become_results(spark, tmp_path):
    folder = make_folder(tmp_path)
    docs = files.ingest(files.scan(spark, str(folder)))
    wanted = docs.select(F.col("file_path").alias("path")).unionByName(
        spark.createDataFrame([("file:/nowhere/x.txt",)], "path string")
    )
    every = docs.unionByName(files.not_found(wanted, docs), allowMissingColumns=True)
    results = {r.file_name: r for r in paperloom.process(every).collect()}
    gone = results["x.txt"]
    assert (gone.success, gone.status, gone.document_type) == (False, "failed", None)
    assert gone.errors == ["File not found: file:/nowhere/x.txt"]
    assert results["e.docx"].errors == ["Unsupported file type: docx"]
    assert results["a.TXT"].redacted_text == "Mail [EMAIL REDACTED]\nné\nend"
    m = paperloom.batch_metrics(paperloom.process(every)).first()
    assert (m.total_documents, m.successful_documents) == (9, 5)


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.com"), (2, "x")], "doc_id long, text string")
    results = paperloom.process(docs)
    sinks.write_results(results, str(tmp_path / "r"))
    sinks.write_results(results, str(tmp_path / "j"), "json")
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and "document_type" in back.columns
    metrics = paperloom.batch_metrics(back)
    sinks.write_metrics(metrics, str(tmp_path / "m"))
    again = sinks.read_metrics(spark, str(tmp_path / "m"), metrics.schema).first()
    assert again.total_documents == 2 and again.pii_total_detected == 1
    log = decision_rows(results, "audit")
    for session in ("s1", "s2"):
        sinks.append_decisions(log, str(tmp_path / "log"), session)
    saved = spark.read.parquet(str(tmp_path / "log"))
    assert saved.where("session_id = 's1'").count() == log.count() == saved.count() // 2


def test_wall_time_wins_over_durations(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumns(
        {
            "started_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
            "finished_at": F.lit("2024-01-01 00:00:01.5").cast("timestamp"),
        }
    )
    assert paperloom.process(docs).first().processing_time_ms == 1500.0


def test_stream_equals_batch(spark, tmp_path):
    folder = make_folder(tmp_path)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        query = stream.start(
            stream.redacted_documents(spark, str(folder)), "test", out, str(tmp_path / "progress")
        )
        query.awaitTermination(120)
    assert spark.read.parquet(out).count() == 8
    got = {r.file_name: (r.redacted_text, r.load_error) for r in spark.read.parquet(out).collect()}
    assert got["a.TXT"] == ("Mail [EMAIL REDACTED]\nné\nend", None)
    assert len(got) == 8 and got["e.docx"][1] == "Unsupported file type: docx"


def test_repair_needs_one_join(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    replies = spark.createDataFrame(
        [], "doc_id long, stage string, attempt int, reply string, error string"
    )
    plan = paperloom.process(docs, replies)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
