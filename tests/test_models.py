"""Folds against plain models of the commands, on random logs."""

import random
from collections import deque

import pytest

from tidefold.operators import limits, oplog, queues, reports, scans, state, streams, structures


def random_log(spark, seed, n=600, ops=("put", "incr", "delete", "enqueue", "dequeue", "append_event")):
    rng, rows = random.Random(seed), []
    for i in range(n):
        op = rng.choice(ops)
        rows.append((i, float(i), op, f"k{rng.randrange(6)}", f"q{rng.randrange(2)}", f"s{rng.randrange(2)}", rng.randrange(-5, 9), rng.choice(["1", "20", "x", ""]), i + rng.choice([5.0, 200.0]) if rng.random() < 0.3 else None))
    return rows, spark.createDataFrame(rows, oplog.SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_and_counters(spark, seed):
    rows, log = random_log(spark, seed)
    kv, counter, got_counters, old, nx, gone = {}, {}, {}, {}, {}, {}
    for lsn, _, op, key, _, _, amount, value, expiry in rows:
        if op == "put":
            old[lsn] = kv.get(key, (None, None))[0]
            nx[lsn] = int(key not in kv)
            kv[key] = (value, expiry)
            counter[key] = int(value) if value.isdigit() else 0
        elif op == "delete":
            gone[lsn] = int(key in kv)
            kv.pop(key, None)
            counter[key] = 0
        elif op == "incr":
            counter[key] = got_counters[lsn] = counter.get(key, 0) + amount
    as_of = 450.0
    live = {k: v for k, (v, e) in kv.items() if e is None or e > as_of}
    assert {r.key: r.value for r in state.kv_state(log, as_of).collect()} == live
    assert {r.lsn: r.counter for r in state.counters(log).collect()} == got_counters
    assert {r.lsn: r.old for r in state.getset(log).collect()} == old
    assert {r.lsn: r.existed for r in state.deletes(log).collect()} == gone
    assert {r.lsn: r.done for r in state.set_if_absent(log).collect()} == nx


def test_counters_that_expire(spark):
    rows, log = random_log(spark, 5, ops=("incr", "delete"))
    value, expiry, want = {}, {}, {}
    for lsn, ts, op, key, _, _, amount, _, e in rows:
        if key in expiry and expiry[key] is not None and expiry[key] <= ts:
            value.pop(key, None)
            expiry.pop(key)
        if op == "delete":
            value.pop(key, None)
            expiry.pop(key, None)
        else:
            want[lsn] = value[key] = value.get(key, 0) + amount
            expiry[key] = e if e is not None else expiry.get(key)
    assert {r.lsn: r.counter for r in state.ttl_counters(log).collect()} == want


@pytest.mark.parametrize("seed,hot", [(3, 5_000_000), (4, 5_000_000), (3, 10)])
def test_queues_and_streams(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", hot)
    rows, log = random_log(spark, seed)
    q, out, depth, seq, events = {"q0": deque(), "q1": deque()}, {}, {}, {}, {}
    for lsn, _, op, _, queue, stream, _, value, _ in rows:
        if op == "enqueue":
            q[queue].append(value)
        elif op == "dequeue":
            out[lsn] = q[queue].popleft() if q[queue] else None
        if op in ("enqueue", "dequeue"):
            depth[lsn] = len(q[queue])
        if op == "append_event":
            seq[stream] = seq.get(stream, 0) + 1
            events[lsn] = seq[stream]
    assert {r.lsn: r.value for r in queues.dequeues(log).collect()} == out
    assert {r.lsn: r.depth for r in queues.walk(log).collect()} == depth
    assert {r.queue: r.depth for r in queues.depths(log).collect()} == {k: len(v) for k, v in q.items()}
    left = {}
    for r in sorted(queues.remaining(log).collect(), key=lambda r: r.place):
        left.setdefault(r.queue, []).append(r.value)
    assert left == {k: list(v) for k, v in q.items() if v}
    assert {r.lsn: r.seq for r in streams.sequenced(log).collect()} == events
    with pytest.raises(ValueError):
        streams.read_after(streams.sequenced(log), "s0", 0, -1)


def test_flush_restarts_sequences(spark):
    _, log = random_log(spark, 6)
    flushes = spark.createDataFrame([(100,), (400,)], "lsn long")
    rows = streams.sequenced(oplog.with_epochs(log, flushes)).collect()
    assert {r.epoch for r in rows} == {0, 1, 2} and all((r.epoch == 0) == (r.lsn < 100) and (r.epoch == 2) == (r.lsn >= 400) for r in rows)
    first = {}
    for r in sorted(rows, key=lambda r: r.lsn):
        assert r.seq == first.get((r.epoch, r.stream), 0) + 1
        first[r.epoch, r.stream] = r.seq


def test_lists(spark):
    rng, rows, want = random.Random(8), [], {}
    for i in range(400):
        key, op = f"l{rng.randrange(4)}", rng.choice(["lpush", "rpush", "lpop", "rpop", "lpushx", "rpushx"])
        rows.append((i, key, op, str(rng.randrange(5))))
        d = want.setdefault(key, deque())
        if op == "lpush" or (op == "lpushx" and d):
            d.appendleft(rows[-1][3])
        elif op == "rpush" or (op == "rpushx" and d):
            d.append(rows[-1][3])
        elif op in ("lpop", "rpop") and d:
            d.popleft() if op == "lpop" else d.pop()
    log = spark.createDataFrame(rows, "lsn long, key string, op string, value string")
    assert {r.key: r["items"] for r in structures.folded(log).collect()} == {k: list(v) for k, v in want.items()}


@pytest.mark.parametrize("first,last", [(0, -1), (1, 2), (-2, -1), (-100, 1), (3, 1), (5, 9), (0, 0)])
def test_list_ranges(spark, first, last):
    from pyspark.sql import functions as F

    items = list("abcd")
    n = len(items)
    a, b = max(first + n if first < 0 else first, 0), min(last + n if last < 0 else last, n - 1)
    df = spark.createDataFrame([(items,)], "items array<string>")
    assert df.select(structures.lrange(F.col("items"), first, last)).first()[0] == items[a : b + 1]


@pytest.mark.parametrize("count", [0, 1, 2, -1, -2, 9])
def test_list_removal(spark, count):
    from pyspark.sql import functions as F

    items = list("xaxbxcx")
    want, left = list(items), abs(count) or 99
    order = range(len(items) - 1, -1, -1) if count < 0 else range(len(items))
    for i in [i for i in order if items[i] == "x"][:left]:
        want[i] = None
    df = spark.createDataFrame([(items,)], "items array<string>")
    assert df.select(structures.lrem(F.col("items"), F.lit("x"), count)).first()[0] == [x for x in want if x]


def test_sliding_limit_ignores_rejected_calls(spark):
    rows = [(i, "a", float(i)) for i in range(30)]
    held, want = [], {}
    for i, _, ts in rows:
        held = [x for x in held if x > ts - 10]
        want[i] = len(held) < 3
        if want[i]:
            held.append(ts)
    got = {r.id: r.allowed for r in limits.sliding(spark.createDataFrame(rows, "id long, key string, ts double"), 10.0, 3).collect()}
    assert got == want


def test_rename_missing_key(spark):
    kv = spark.createDataFrame([("a", "1", None)], "key string, value string, expires_at double")
    with pytest.raises(KeyError):
        state.rename(kv, "b", "c")
    assert state.rename(kv, "a", "a").collect() == []


@pytest.mark.parametrize("pattern,key,hit", [("user:*", "user:1", True), ("u?er", "user", True), ("u?er", "ur", False), ("[ab]x", "bx", True), ("a.b", "axb", False), ("*", "", True), ("a*c", "abcd", False)])
def test_glob(spark, pattern, key, hit):
    kv = spark.createDataFrame([(key,)], "key string")
    assert (state.keys_matching(kv, pattern).count() == 1) == hit


def test_mset_if_absent(spark):
    rng = random.Random(9)
    rows = [(i, {f"k{x}": "v" for x in rng.sample(range(60), rng.randint(1, 3))}) for i in range(150)]
    held, want = set(), {}
    for i, m in rows:
        want[i] = int(not held & set(m))
        if want[i]:
            held |= set(m)
    got = state.mset_if_absent(spark.createDataFrame(rows, "lsn long, mapping map<string,string>"))
    assert {r.lsn: r.done for r in got.collect()} == want


def test_getdel_scan_and_milliseconds(spark):
    log = spark.createDataFrame([(1, "put", "a", "1"), (2, "delete", "a", None), (3, "delete", "a", None), (4, "put", "a", None), (5, "delete", "a", None)], "lsn long, op string, key string, value string")
    assert {r.lsn: r.old for r in state.getdel(log).collect()} == {2: "1", 3: None, 5: None}
    kv = spark.createDataFrame([(f"k{i}", str(i), 10.25 if i % 2 else None) for i in range(8)], "key string, value string, expires_at double")
    first = [r.key for r in state.scan_page(kv, None, "k[1-6]", 4).collect()]
    assert first == ["k1", "k2", "k3", "k4"] and [r.key for r in state.scan_page(kv, first[-1], "k[1-6]", 4).collect()] == ["k5", "k6"]
    with pytest.raises(ValueError):
        state.scan_page(kv, count=0)
    keys = spark.createDataFrame([("k0",), ("k1",), ("x",)], "key string")
    assert {r.key: r.ttl for r in state.ttl_millis(kv, 10.0, keys).collect()} == {"k0": -1, "k1": 250, "x": -2}


@pytest.mark.parametrize("hot", [5_000_000, 3])
def test_order_statistics(spark, hot, monkeypatch):
    import statistics

    monkeypatch.setattr(scans, "HOT_ROWS", hot)
    rng = random.Random(4)
    groups = {"a": [rng.randrange(9) / 2 for _ in range(41)], "b": [rng.random() for _ in range(40)], "c": [3.5]}
    rows = spark.createDataFrame([(g, v) for g, x in groups.items() for v in [*x, None]], "g string, v double")
    got = {r.g: r for r in reports.series_summary(rows, ["g"], "v").collect()}
    cut = {r.g: r for r in reports.exclusive_quantiles(rows, ["g"], "v", (95, 99)).collect()}
    for g, x in groups.items():
        s = sorted(x)
        at = lambda p: s[round(p / 100 * (len(s) - 1))]  # noqa: B023, E731
        assert (got[g].n, got[g].min, got[g].p50, got[g].p95, got[g].p99, got[g].max) == (len(s), s[0], at(50), at(95), at(99), s[-1])
        if len(s) > 1:
            assert cut[g].p95 == pytest.approx(statistics.quantiles(s, n=20)[18]) and cut[g].p99 == pytest.approx(statistics.quantiles(s, n=100)[98])
        else:
            assert cut[g].p95 == cut[g].p99 == 3.5


def test_access_codes(spark):
    from tidefold.operators import crm

    rows = [(1, 7, 0.0, "verify", "x", None), (2, 7, 1.0, "set", "x", 10.0), (3, 7, 2.0, "verify", "y", None), (4, 7, 10.0, "verify", "x", None), (5, 7, 10.0, "verify", "x", None),
            (6, 7, 11.0, "set", "z", 12.0), (7, 7, 12.5, "verify", "z", None), (8, 8, 11.0, "verify", "z", None), (9, 7, 13.0, "set", "z", 20.0), (10, 7, 14.0, "verify", "z", None)]
    log = spark.createDataFrame(rows, "lsn long, customer_id long, ts double, op string, code string, expires_at double")
    assert {r.lsn for r in crm.access_codes(log).where("ok").collect()} == {4, 10}
