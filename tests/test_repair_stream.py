"""Records and replies as streams, in any order, against the batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import replies, validate
from paperloom.streaming import documents, repairs

RECORD = "doc_id string, document_type string, structured_data map<string,string>, at timestamp"
REPLY = "doc_id string, stage string, attempt int, reply string, error string, at timestamp"
T0 = "2024-01-01 00:00:00"
GOOD = {"date": "2024-01-15", "total_amount": "1.00", "merchant_name": "M"}


def fix(**values):
    return json.dumps({"corrected_fields": values})


def made():
    """Records that are right, without data, and faulty in one to three fields, with three replies each."""
    draws, records, answers = random.Random(3), [], []
    for i in range(60):
        data = dict(GOOD)
        for field in draws.sample(sorted(GOOD), i % 4):
            data[field] = draws.choice([None, "", "bad"])
        records.append((f"d{i}", "receipt", None if i % 13 == 0 else data))
        for k in (1, 2, 3):
            reply = draws.choice([fix(date="2024-02-02"), fix(merchant_name="N", total_amount="2"), fix(), "{", None])
            answers.append((f"d{i}", "repair", k, reply, "timed out" if reply is None else None))
    return records, answers


def feed(spark, folder, rows, schema, n):
    """One file for each of n parts, to be taken one a batch."""
    schema_ = schema.replace(", at timestamp", ", at string")
    for part in range(n):
        spark.createDataFrame(rows[part::n] or [], schema_).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)


def streams(spark, base):
    out = []
    for name, schema in (("records", RECORD), ("replies", REPLY)):
        out.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}"))
    return out


def run(spark, base, name, **options):
    done = repairs.repaired(*streams(spark, base), **options).select(
        "doc_id", "status", "unused", "structured_data", F.col("validation.is_valid").alias("valid"), F.col("validation.attempts").alias("attempts"), F.size("validation.errors").alias("n")
    )
    documents.start(done, name, f"{base}/out", f"{base}/progress").awaitTermination()
    return [r.asDict() for r in spark.read.schema(done.schema).parquet(f"{base}/out").collect()]


def batch(spark, records, answers):
    schema = RECORD.replace(", at timestamp", "")
    gathered = replies.gather(spark.createDataFrame(answers, REPLY.replace(", at timestamp", "")))
    done = validate.validate(replies.attach(spark.createDataFrame(records, schema), gathered), replies.corrections())
    rows = done.select("doc_id", "structured_data", F.col("validation.is_valid").alias("valid"), F.col("validation.attempts").alias("attempts"), F.size("validation.errors").alias("n"))
    return {r["doc_id"]: r.asDict() for r in rows.collect()}


@pytest.mark.parametrize("order", ["records first", "replies first", "mixed"])
def test_any_order_gives_the_batch(spark, tmp_path, order):
    records, answers = made()
    draws = random.Random(8)
    draws.shuffle(records)
    draws.shuffle(answers)
    answers += draws.sample(answers, 40)  # duplicates
    late = {"records first": (0, 100), "replies first": (100, 0), "mixed": (0, 0)}[order]
    base = str(tmp_path)

    def at(k, shift):
        return f"2024-01-01 00:{(k * 7 + shift) % 9:02d}:00"  # within the delay, so nothing is late

    feed(spark, f"{base}/records", [(*r, at(k, late[0])) for k, r in enumerate(records)], RECORD, 2)
    feed(spark, f"{base}/replies", [(*r, at(k, late[1])) for k, r in enumerate(answers)], REPLY, 4)
    if order != "mixed":  # one side waits until the other one is read: its files are the newer ones
        side = f"{base}/{'replies' if order == 'records first' else 'records'}"
        for name in os.listdir(side):
            os.utime(f"{side}/{name}", (2e9, 2e9))
    got = {r["doc_id"]: r for r in run(spark, base, f"any {order}") if r["status"] == "complete"}
    want = batch(spark, records, answers)
    assert set(got) == set(want)
    for doc_id, row in want.items():
        assert {k: got[doc_id][k] for k in row} == row


def test_timers_late_replies_and_orphans(spark, tmp_path):
    base, bad = str(tmp_path), {**GOOD, "date": "x"}
    feed(spark, f"{base}/records", [("waits", "receipt", bad, T0), ("right", "receipt", GOOD, T0)], RECORD, 1)
    feed(spark, f"{base}/replies", [("waits", "repair", 2, fix(date="2024-03-03"), None, T0), ("nobody", "repair", 1, fix(), None, T0), ("right", "repair", 9, fix(), None, T0)], REPLY, 1)
    rows = run(spark, base, "timers", wait_ms=60_000)
    assert [r["doc_id"] for r in rows] == ["right"]
    # A reply that is too late for the watermark, a late one to a record that was given, and time goes on.
    for k, day in enumerate(("2024-01-02", "2024-01-03", "2024-01-04")):
        feed(spark, f"{base}/records", [(f"on{k}", "receipt", GOOD, f"{day} 00:00:00")], RECORD, 1)
        feed(spark, f"{base}/replies", [("waits", "repair", 1, fix(date="2024-04-04"), None, T0), (f"on{k}", "repair", 1, fix(), None, f"{day} 00:00:00")], REPLY, 1)
        rows = run(spark, base, f"timers {k}", wait_ms=60_000)  # starts again from the checkpoint
    found = {(r["doc_id"], r["status"]): r for r in rows}
    assert len(found) == len(rows)
    assert found["waits", "expired"]["structured_data"]["date"] in ("2024-03-03", "2024-04-04") and found["waits", "expired"]["valid"]
    assert ("nobody", "orphan") in found and found["right", "late"]["unused"] == 1
    assert ("on0", "complete") in found and found["on0", "late"]["unused"] == 1


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    base, bad = str(tmp_path), {**GOOD, "date": "x"}
    feed(spark, f"{base}/records", [("d", "receipt", bad, T0)], RECORD, 1)
    feed(spark, f"{base}/replies", [("d", "repair", 1, fix(), None, T0)], REPLY, 1)
    assert run(spark, base, "restart 1") == []
    feed(spark, f"{base}/replies", [("d", "repair", k, fix(date="2024-05-05"), None, T0) for k in (2, 3)], REPLY, 1)
    got = run(spark, base, "restart 2")
    assert [(r["doc_id"], r["status"], r["valid"], r["attempts"]) for r in got] == [("d", "complete", True, 2)]
    assert run(spark, base, "restart 3") == got


@pytest.mark.parametrize("buckets", [1, 3])
def test_documents_of_one_bucket_keep_their_own_timers(spark, tmp_path, buckets):
    base, bad = str(tmp_path), {**GOOD, "date": "x"}
    many = [(f"m{k}", "receipt", bad, T0) for k in range(20)]
    feed(spark, f"{base}/records", [*many, (None, "receipt", bad, T0), ("later", "receipt", bad, "2024-01-01 02:00:00")], RECORD, 1)
    feed(spark, f"{base}/replies", [("m3", "repair", k, fix(date="2024-05-05"), None, T0) for k in (1, 2, 3)] + [("nobody", "repair", 1, None, None, T0)], REPLY, 1)
    got = {(r["doc_id"], r["status"]): r for r in run(spark, base, f"buckets {buckets} 1", wait_ms=60_000, buckets=buckets)}
    given = {("m3", "complete"), (None, "expired"), ("nobody", "orphan"), *((f"m{k}", "expired") for k in range(20) if k != 3)}
    assert set(got) == given and got["m3", "complete"]["valid"] and not got["m4", "expired"]["valid"]
    feed(spark, f"{base}/replies", [("later", "repair", k, fix(date="2024-06-06"), None, "2024-01-01 02:00:00") for k in (1, 2, 3)], REPLY, 1)
    got = {(r["doc_id"], r["status"]) for r in run(spark, base, f"buckets {buckets} 2", wait_ms=60_000, buckets=buckets)}
    assert got == given | {("later", "complete")}


def test_state_lies_on_disk_and_buckets_stay_small(spark, tmp_path):
    name, base = "spark.sql.streaming.stateStore.providerClass", str(tmp_path)
    before, bad = spark.conf.get(name), {**GOOD, "date": "x"}
    feed(spark, f"{base}/records", [(f"d{k}", "receipt", bad, T0) for k in range(50)], RECORD, 1)
    feed(spark, f"{base}/replies", [(f"d{k}", "repair", 1, fix(), None, T0) for k in range(50)], REPLY, 1)
    assert run(spark, base, "on disk") == [] and spark.conf.get(name) == before
    with open(f"{base}/progress/offsets/0") as file:
        assert json.loads(file.read().splitlines()[1])["conf"][name].endswith("RocksDBStateStoreProvider")
    feed(spark, f"{base}/replies", [(f"d{k}", "repair", n, fix(date="2024-05-05"), None, T0) for k in range(50) for n in (2, 3)], REPLY, 1)
    got = run(spark, base, "on disk again")
    assert sorted(r["doc_id"] for r in got) == sorted(f"d{k}" for k in range(50)) and all(r["valid"] for r in got)
    for docs in (0, 1, 150_000, 54_000_000):
        buckets = repairs.buckets_for(docs)
        assert buckets >= repairs.BUCKETS and buckets * repairs.BUCKET_DOCS >= docs
