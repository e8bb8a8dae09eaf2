import json
import os

import pytest
from pyspark.sql import functions as F

from tidefold.functions.text import jaccard, slugify, tokens, valid_key
from tidefold.operators import oplog, state
from tidefold.sources import files, frames, shared
from tidefold.streaming import online

DATA = "/root/testdata/sf0.001"


def test_log_round_trip(spark, tmp_path):
    rows = [(1, 0.0, "put", "k", None, None, None, "é \U0001f600", None), (2, 1.0, "put", "n", None, None, None, None, 9.0)]
    log = spark.createDataFrame(rows, oplog.SCHEMA)
    files.append_log(log, f"{tmp_path}/log")
    files.append_log(log.withColumn("lsn", F.col("lsn") + 10).withColumn("value", F.lit("new")), f"{tmp_path}/log")
    got = {r.key: r.value for r in state.kv_state(files.read_log(spark, f"{tmp_path}/log"), 5.0).collect()}
    assert got == {"k": "new", "n": "new"}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [(r.raw, r.a) for r in files.read_json_lines(spark, f"{tmp_path}/a.jsonl", "a int").collect()] == [('{"a": 1}', 1), ('{"a": 2}', 2)]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/b.jsonl", "a int").collect()


def test_manifest_reports_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_text("{}\n{}\n")
    (tmp_path / "in/y.bin").write_bytes(b"abc")
    m = files.lock_manifest(spark, f"{tmp_path}/in", expected=["x.jsonl", "y.bin", "z"])
    rows = {r.name: r for r in m.collect()}
    assert rows["x.jsonl"].lines == 2 and rows["y.bin"].lines is None and rows["y.bin"].bytes == 3 and not rows["z"].exists
    assert rows["y.bin"].sha256.startswith("ba7816bf")
    small = m.select("name", "exists")
    for kind in ("json", "csv", "markdown"):
        files.write_report(small, f"{tmp_path}/{kind}", kind)
    text = spark.read.text(f"{tmp_path}/markdown").collect()
    assert text[0].value == "| name | exists |" and len(text) == 5
    files.audit(small, f"{tmp_path}/audit")
    files.audit(small, f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 6


def test_compaction(spark, tmp_path):
    rows = [(1, "c", 1, "upsert", None), (2, "c", 1, "upsert", None), (3, "c", 2, "upsert", None), (4, "c", 2, "delete", None), (5, "c", 3, "upsert", 10.0)]
    spark.createDataFrame(rows, "lsn long, collection string, id int, op string, expires_at double").write.parquet(f"{tmp_path}/old")
    kept = files.compact(spark, f"{tmp_path}/old", f"{tmp_path}/new", as_of=10.0).collect()
    assert [(r.id, r.lsn, r.since) for r in kept] == [(1, 2, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_streaming_keys_equal_batch(spark):
    log = oplog.from_events(spark.read.parquet(f"{DATA}/events.parquet")).withColumn("expires_at", F.lit(None).cast("double"))
    want = {r.key: (r.value, r.last_lsn) for r in state.kv_state(log, 0.0).collect()}
    assert {r.key: (r.value, r.last_lsn) for r in online.kv_view(spark, f"{DATA}/events.parquet").collect()} == want


RECORDS = [{"op": "put", "key": "k", "value": "x" * 200, "ts": 1.5}, {"op": "delete", "key": "k", "ts": 2.0}, {"op": "incr", "key": "é", "amount": 3, "ts": 3.0}]


@pytest.mark.parametrize("codec", ["gzip", "zstd"])
def test_frames_round_trip(spark, tmp_path, codec):
    (tmp_path / "0001.log").write_bytes(frames.packed(RECORDS, codec=codec) + frames.packed(RECORDS[1:], batch=True))
    (tmp_path / "0002.log").write_bytes(b"")
    rows = frames.read_frames(spark, str(tmp_path)).orderBy("path", "number").collect()
    assert [(r.op, r.key, r.value, r.amount, r.ts) for r in rows] == [(x["op"], x["key"], x.get("value"), x.get("amount"), x["ts"]) for x in RECORDS + RECORDS[1:]]
    assert [r.number for r in rows] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("cut", [1, 3, 10])
def test_cut_off_frames_are_errors(spark, tmp_path, cut):
    data = frames.packed(RECORDS)
    with pytest.raises(frames.TruncatedFrame):
        list(frames.frames(data[:-cut]))
    (tmp_path / "a.log").write_bytes(data[:-cut])
    with pytest.raises(Exception, match="cut off"):
        frames.read_frames(spark, str(tmp_path)).collect()
    rows = frames.read_frames(spark, str(tmp_path), salvage=True).orderBy("number").collect()
    assert [r.op for r in rows] == ["put", "delete", None] and "cut off" in rows[-1].error
    with pytest.raises(ValueError):
        frames.unpacked(b"\x07?")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_a_batch_that_is_run_again_is_not_counted_twice(spark):
    e = online.events(spark, f"{DATA}/events.parquet").select("event_id", "user_id")
    where, first, again = shared.new_folder(spark, "t"), shared.new_folder(spark, "t"), shared.new_folder(spark, "t")
    for state_folder in (first, again):  # a lost checkpoint: batch 0 runs twice
        online.start(e, "append", where, state_folder).awaitTermination()
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert spark.read.parquet(where).count() == n


def test_late_rows_are_dropped(spark, tmp_path):
    schema, src, where, state_folder = "i int, ts timestamp", tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    batches = [[(1, 0), (2, 5)], [(3, 100)], [(4, 7), (5, 101)], [(6, 300)]]
    for b, rows in enumerate(batches):
        spark.createDataFrame([(i, s) for i, s in rows], "i int, s long").select("i", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        online.start(online.closed_windows(stream, "10 seconds", "20 seconds"), "append", where, state_folder).awaitTermination()
    got = {r.start: r.n for r in spark.read.parquet(where).collect()}
    assert got == {0: 2, 100: 2}  # the row at 7 came after the watermark had passed it


def test_queue_view_equals_batch(spark):
    from tidefold.operators import queues

    log = oplog.from_events(spark.read.parquet(f"{DATA}/events.parquet"))
    assert {r.queue: r.depth for r in online.queue_view(spark, f"{DATA}/events.parquet").collect()} == {r.queue: r.depth for r in queues.depths(log).collect()}


def test_queue_view_orders_rows_of_all_frames(spark, tmp_path):
    rows = [(i, 8, "click" if i % 7 in (0, 3, 4) else "error", 0) for i in range(1, 600)]
    want = depth = 0
    for i, _, kind, _ in rows:
        if kind == "click" or i % 2:
            depth = depth + 1 if kind == "click" else max(0, depth - 1)
            want += kind == "click"
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    events.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = online.queue_view(spark, f"{tmp_path}/events.parquet").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [tuple(r) for r in got] == [("q0", depth, want, want - depth, max(i for i, _, k, _ in rows if k == "click" or i % 2))]


def test_intermediate_tables_can_be_deleted(spark):
    kept = shared.keep(spark.range(5).select(F.col("id"), (F.col("id") % 2).alias("b")), ["b"])
    assert kept.count() == 5 and shared.release(spark) >= 1
    assert shared.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


def test_text_functions(spark):
    df = spark.createDataFrame([("The cat, CAT_9!",), ("",), ("a b",)], "t string")
    assert [sorted(r[0]) for r in df.select(tokens(F.col("t"))).collect()] == [sorted({"the", "cat", "cat_9", "at_", "t_9"}), [], ["a", "b"]]
    assert df.select(jaccard(tokens(F.col("t")), tokens(F.lit("cat")))).first()[0] == pytest.approx(1 / 5)
    assert [r[0] for r in df.select(slugify(F.col("t"))).collect()] == ["the_cat_cat_9", "slice", "a_b"]
    keys = spark.createDataFrame([("a:b-c_1.",), ("a b",), ("",), ("x" * 1025,)], "k string")
    assert [r[0] for r in keys.select(valid_key(F.col("k"))).collect()] == [True, False, False, False]


def test_library_does_not_need_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for base, _, names in os.walk(os.path.join(root, "tidefold")):
        if os.path.basename(base) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "tidefold.llm" not in open(os.path.join(base, n)).read()
    assert json.dumps({}) == "{}"
