"""Queries of the state operators: keys, counters, queues, streams, lists and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.text import valid_key
from tidefold.operators import oplog, queues, state, streams, structures

AS_OF = 1706000000.0
QUERIES: dict = {}
SQL: dict[str, str] = {}

LOG = """
WITH log AS (
  SELECT event_id AS lsn, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
         CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'incr' WHEN 'view' THEN 'append_event' WHEN 'click' THEN 'enqueue'
              ELSE CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'dequeue' END END AS op,
         'user:' || user_id AS key, 'q' || user_id % 8 AS queue, 's' || user_id % 8 AS stream, floor(value)::BIGINT AS amount, props AS value,
         CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) / 1000000.0::DOUBLE + 86400 END AS expires_at
  FROM events),
kv AS (
  SELECT key, s.value AS value, s.expires_at AS expires_at, last_lsn
  FROM (SELECT key, arg_max({'op': op, 'value': value, 'expires_at': expires_at}, lsn) AS s, max(lsn) AS last_lsn FROM log WHERE op IN ('put', 'delete') GROUP BY key)
  WHERE s.op = 'put' AND (s.expires_at IS NULL OR s.expires_at > 1706000000.0)),
ask AS (SELECT i AS pos, 'user:' || (i * 7) % 200 AS key FROM range(0, 60) t(i))
"""


def query(sql: str | None = None, log: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = (LOG if log else "") + sql
            SQL[f.__name__] = text.replace("WITH", "WITH RECURSIVE", 1) if recursive else text
        return f

    return add


def the_log(spark: SparkSession, d: str) -> DataFrame:
    return oplog.from_events(spark.read.parquet(f"{d}/events.parquet"))


def ask(spark: SparkSession) -> DataFrame:
    return spark.range(60).select(F.col("id").alias("pos"), F.concat(F.lit("user:"), (F.col("id") * 7 % 200).cast("string")).alias("key"))


def kv(spark, d):
    return state.kv_state(the_log(spark, d), AS_OF)


@query("SELECT * FROM kv")
def kv_state_lww(spark, d):
    return kv(spark, d)


@query("SELECT a.key, CASE WHEN kv.key IS NULL THEN 'none' ELSE kv.value END AS value FROM ask a LEFT JOIN kv ON a.key = kv.key")
def kv_get_default(spark, d):
    return state.get(kv(spark, d), ask(spark).select("key"), "none")


@query("SELECT a.pos, a.key, kv.value FROM ask a LEFT JOIN kv ON a.key = kv.key")
def kv_mget(spark, d):
    return state.mget(kv(spark, d), ask(spark))


@query("SELECT count(*)::BIGINT AS n FROM ask a WHERE a.key IN (SELECT key FROM kv)")
def kv_exists_multi(spark, d):
    return state.exists_count(kv(spark, d), ask(spark).select("key"))


@query("""
, g AS (SELECT key, lsn, op, coalesce(max(CASE WHEN op = 'delete' THEN lsn END) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS gone
        FROM log WHERE op IN ('put', 'delete') AND key LIKE 'user:1%'),
f AS (SELECT key, arg_max(since, gone) AS since FROM (SELECT key, gone, min(lsn) AS since FROM g WHERE op = 'put' GROUP BY key, gone) GROUP BY key)
SELECT key, since FROM f WHERE key IN (SELECT key FROM kv)""")
def kv_keys_prefix(spark, d):
    return state.keys_with_prefix(the_log(spark, d), AS_OF, "user:1")


@query("SELECT key FROM kv WHERE regexp_full_match(key, 'user:[12].*5')")
def kv_keys_glob(spark, d):
    return state.keys_matching(kv(spark, d), "user:[12]*5")


@query("SELECT a.key, CASE WHEN kv.key IS NULL THEN NULL WHEN kv.expires_at IS NULL THEN -1.0 ELSE round(greatest(kv.expires_at - 1706000000.0, 0), 3) END::DOUBLE AS ttl FROM ask a LEFT JOIN kv ON a.key = kv.key")
def kv_ttl_asof(spark, d):
    return state.ttl(kv(spark, d), AS_OF, ask(spark).select("key")).withColumn("ttl", F.round("ttl", 3))


@query("SELECT a.key, CASE WHEN kv.key IS NULL THEN -2 WHEN kv.expires_at IS NULL THEN -1 ELSE trunc(kv.expires_at - 1706000000.0) END::BIGINT AS ttl FROM ask a LEFT JOIN kv ON a.key = kv.key")
def kv_ttl_wire(spark, d):
    return state.ttl_seconds(kv(spark, d), AS_OF, ask(spark).select("key"))


@query("SELECT key, value, CASE WHEN hash_key THEN NULL ELSE 1706000000.0 + 60 END::DOUBLE AS expires_at FROM (SELECT key, value, key LIKE '%5' AS hash_key FROM kv)")
def kv_expire_persist(spark, d):
    s = kv(spark, d)
    seconds = F.when(~F.col("key").like("%5"), 60)
    return state.expire(s, s.select("key", seconds.alias("seconds")), AS_OF)


@query("SELECT CASE WHEN key = 'user:1' THEN 'moved' ELSE key END AS key, value, CASE WHEN key = 'user:1' THEN NULL ELSE expires_at END AS expires_at FROM kv WHERE key <> 'moved' AND EXISTS (SELECT 1 FROM kv WHERE key = 'user:1') UNION ALL SELECT key, value, expires_at FROM kv WHERE NOT EXISTS (SELECT 1 FROM kv WHERE key = 'user:1')")
def kv_rename(spark, d):
    s = kv(spark, d)
    try:
        return state.rename(s, "user:1", "moved")
    except KeyError:
        return s.select("key", "value", "expires_at")


@query("""
, r AS (SELECT lsn, key, op, CASE WHEN op = 'put' THEN coalesce(try_cast(value AS BIGINT), 0) WHEN op = 'incr' THEN amount ELSE 0 END AS x,
               sum(CASE WHEN op <> 'incr' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY lsn) AS seg FROM log WHERE op IN ('put', 'delete', 'incr')),
c AS (SELECT lsn, key, op, sum(x) OVER (PARTITION BY key, seg ORDER BY lsn)::BIGINT AS counter FROM r)
SELECT lsn, key, counter FROM c WHERE op = 'incr'""")
def kv_incr_running(spark, d):
    return state.counters(the_log(spark, d))


@query("SELECT key, sum(amount)::BIGINT AS counter, count(*)::BIGINT AS n FROM log WHERE op = 'incr' GROUP BY key")
def kv_counter_state(spark, d):
    return state.counter_state(the_log(spark, d))


@query("""
, r AS (SELECT key, lsn, ts, op, amount, expires_at, row_number() OVER (PARTITION BY key ORDER BY lsn) AS n FROM log WHERE op IN ('incr', 'delete')),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS lsn, NULL::VARCHAR AS op, NULL::BIGINT AS value, NULL::DOUBLE AS expiry FROM r
  UNION ALL
  SELECT r.key, r.n, r.lsn, r.op, CASE WHEN r.op = 'incr' THEN coalesce(CASE WHEN f.expiry <= r.ts THEN NULL ELSE f.value END, 0) + r.amount END,
         CASE WHEN r.op = 'incr' THEN coalesce(r.expires_at, CASE WHEN f.expiry <= r.ts THEN NULL ELSE f.expiry END) END
  FROM f JOIN r ON f.key = r.key AND r.n = f.n + 1)
SELECT key, lsn, value AS counter FROM f WHERE op = 'incr'""", recursive=True)
def kv_incr_ttl(spark, d):
    return state.ttl_counters(the_log(spark, d))


@query("""
, u AS (SELECT lsn, unnest([{'p': 0, 'key': 'user:' || lsn % 10, 'a': amount}, {'p': 1, 'key': 'all', 'a': 1}, {'p': 2, 'key': 'user:' || lsn % 10, 'a': 2}]) AS u FROM log WHERE op = 'incr'),
r AS (SELECT lsn, u.p, u.key AS key, sum(u.a) OVER (PARTITION BY u.key ORDER BY lsn, u.p)::BIGINT AS c FROM u)
SELECT lsn, key, arg_max(c, p) AS counter FROM r GROUP BY lsn, key""")
def kv_mincr(spark, d):
    user = F.concat(F.lit("user:"), (F.col("lsn") % 10).cast("string"))
    update = lambda k, a: F.struct(k.alias("key"), a.cast("long").alias("amount"))
    commands = the_log(spark, d).where("op = 'incr'").select("lsn", F.array(update(user, F.col("amount")), update(F.lit("all"), F.lit(1)), update(user, F.lit(2))).alias("updates"))
    return state.mincr(commands)


@query("SELECT lsn, 2 AS n, unnest(['k' || lsn % 5, 'last']) AS key, unnest([value, lsn::VARCHAR]) AS value FROM log WHERE op = 'put'")
def kv_mset(spark, d):
    puts = the_log(spark, d).where("op = 'put'")
    mapping = F.create_map(F.concat(F.lit("k"), (F.col("lsn") % 5).cast("string")), F.col("value"), F.lit("last"), F.col("lsn").cast("string"))
    return state.mset(puts.select("lsn", mapping.alias("mapping")))


@query("""
, r AS (SELECT lsn, key, op, lag({'op': op, 'value': value}) OVER (PARTITION BY key ORDER BY lsn) AS p FROM log WHERE op IN ('put', 'delete'))
SELECT lsn, key, CASE WHEN p.op = 'put' THEN p.value END AS old FROM r WHERE op = 'put'""")
def kv_getset(spark, d):
    return state.getset(the_log(spark, d))


@query("""
, r AS (SELECT lsn, key, op, lag({'op': op, 'value': value}) OVER (PARTITION BY key ORDER BY lsn) AS p FROM log WHERE op IN ('put', 'delete'))
SELECT lsn, key, CASE WHEN p.op = 'put' THEN p.value END AS old FROM r WHERE op = 'delete'""")
def kv_getdel(spark, d):
    return state.getdel(the_log(spark, d))


@query("""
, c AS (SELECT lsn, row_number() OVER (ORDER BY lsn) AS n, ['a' || lsn % 150, 'b' || lsn % 70] AS ks FROM log WHERE op = 'put'),
f AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS lsn, 0 AS done, []::VARCHAR[] AS held
  UNION ALL
  SELECT c.n, c.lsn, CASE WHEN len(list_intersect(c.ks, f.held)) = 0 THEN 1 ELSE 0 END, CASE WHEN len(list_intersect(c.ks, f.held)) = 0 THEN list_concat(f.held, c.ks) ELSE f.held END
  FROM f JOIN c ON c.n = f.n + 1)
SELECT lsn, done FROM f WHERE n > 0""", recursive=True)
def kv_msetnx(spark, d):
    name = lambda p, m: F.concat(F.lit(p), (F.col("lsn") % m).cast("string"))
    mapping = F.create_map(name("a", 150), F.col("value"), name("b", 70), F.col("value"))
    return state.mset_if_absent(the_log(spark, d).where("op = 'put'").select("lsn", mapping.alias("mapping")))


@query("SELECT a.key, CASE WHEN kv.key IS NULL THEN -2 WHEN kv.expires_at IS NULL THEN -1 ELSE floor((kv.expires_at - 1706000000.0) * 1000) END::BIGINT AS ttl FROM ask a LEFT JOIN kv ON a.key = kv.key")
def kv_pttl(spark, d):
    return state.ttl_millis(kv(spark, d), AS_OF, ask(spark).select("key"))


@query("SELECT key, value, CASE WHEN key LIKE '%5' THEN 1706000000.0 + 1500 / 1000.0::DOUBLE ELSE expires_at END::DOUBLE AS expires_at FROM kv")
def kv_pexpire(spark, d):
    s = kv(spark, d)
    return state.expire_millis(s, s.where("key LIKE '%5'").select("key", F.lit(1500).alias("millis")), AS_OF)


@query("SELECT key, value FROM kv WHERE key > 'user:1' AND regexp_full_match(key, 'user:.*[0-4]') ORDER BY key LIMIT 25")
def kv_scan(spark, d):
    return state.scan_page(kv(spark, d).select("key", "value"), "user:1", "user:*[0-4]", 25)


@query("""
, r AS (SELECT lsn, key, op, lag(op) OVER (PARTITION BY key ORDER BY lsn) AS p FROM log WHERE op IN ('put', 'delete'))
SELECT lsn, key, CASE WHEN p = 'put' THEN 1 ELSE 0 END AS existed FROM r WHERE op = 'delete'""")
def kv_delete_returns(spark, d):
    return state.deletes(the_log(spark, d))


@query("""
, r AS (SELECT lsn, key, op, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY lsn) AS seg FROM log WHERE op IN ('put', 'delete'))
SELECT lsn, key, CASE WHEN row_number() OVER (PARTITION BY key, seg ORDER BY lsn) = 1 THEN 1 ELSE 0 END AS done FROM r WHERE op = 'put'""")
def kv_set_nx(spark, d):
    return state.set_if_absent(the_log(spark, d))


@query("""
, f AS (SELECT lsn FROM log WHERE lsn % 1000 = 999)
SELECT log.lsn, stream, row_number() OVER (PARTITION BY e, stream ORDER BY log.lsn)::BIGINT AS seq, e AS epoch, value AS event
FROM (SELECT log.*, (SELECT count(*) FROM f WHERE f.lsn <= log.lsn)::BIGINT AS e FROM log) log WHERE op = 'append_event'""")
def kv_flush_epoch(spark, d):
    log = the_log(spark, d)
    return streams.sequenced(oplog.with_epochs(log, log.where("lsn % 1000 = 999").select("lsn")))


@query("SELECT count(*)::BIGINT AS n FROM log WHERE lsn > (SELECT max(lsn) FROM log WHERE lsn % 1000 = 999)")
def kv_after_flush(spark, d):
    log = the_log(spark, d).withColumn("op", F.when(F.col("lsn") % 1000 == 999, "flushall").otherwise(F.col("op")))
    return oplog.after_last_flush(log).agg(F.count(F.lit(1)).alias("n"))


@query("""
, w AS (SELECT queue, lsn, sum(CASE WHEN op = 'enqueue' THEN 1 ELSE -1 END) OVER (PARTITION BY queue ORDER BY lsn) AS s FROM log WHERE op IN ('enqueue', 'dequeue')),
x AS (SELECT queue, lsn, s - least(0, min(s) OVER (PARTITION BY queue ORDER BY lsn)) AS depth FROM w),
z AS (SELECT queue, arg_max(depth, lsn) AS depth FROM x GROUP BY queue)
SELECT (SELECT count(*) FROM log)::BIGINT AS records, (SELECT count(*) FROM kv)::BIGINT AS keys, (SELECT count(*) FROM z WHERE depth > 0)::BIGINT AS queues,
       (SELECT count(DISTINCT stream) FROM log WHERE op = 'append_event')::BIGINT AS streams""")
def engine_stats(spark, d):
    return state.stats(the_log(spark, d), AS_OF)


@query("SELECT count(*)::BIGINT AS n FROM kv")
def kv_dbsize(spark, d):
    return kv(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("""
, c AS (SELECT event_id, unnest([0, 1, 2]) AS pos, user_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id, pos, 'n:' || user_id % 5 AS key, pos AS kind FROM c),
x AS (SELECT event_id, pos, key, kind, count(*) FILTER (WHERE kind = 1) OVER (PARTITION BY key ORDER BY event_id, pos) AS total FROM r)
SELECT event_id AS command, pos, CASE WHEN kind = 0 THEN 'OK' ELSE total::VARCHAR END AS reply FROM x""", log=False)
def pipeline_results(spark, d):
    """Pipelines of PING, INCR and GET on one key, each command's reply in order."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    rows = e.select(F.col("event_id").alias("command"), F.concat(F.lit("n:"), (F.col("user_id") % 5).cast("string")).alias("key"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("pos"))
    from pyspark.sql import Window

    total = F.count(F.when(F.col("pos") == 1, 1)).over(Window.partitionBy("key").orderBy("command", "pos"))
    return rows.withColumn("total", total).select("command", "pos", F.when(F.col("pos") == 0, "OK").otherwise(F.col("total").cast("string")).alias("reply"))


SQL["pipeline_results"] = SQL["pipeline_results"].lstrip().removeprefix(",").join(["WITH", ""])

WALK = """
, w AS (SELECT lsn, queue, op, value, sum(CASE WHEN op = 'enqueue' THEN 1 ELSE -1 END) OVER (PARTITION BY queue ORDER BY lsn) AS s,
               sum(CASE WHEN op = 'enqueue' THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY lsn) AS enq_n FROM log WHERE op IN ('enqueue', 'dequeue')),
x AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY queue ORDER BY lsn)) AS depth FROM w),
y AS (SELECT lsn, queue, op, value, depth::BIGINT AS depth, enq_n::BIGINT AS enq_n, (enq_n - depth)::BIGINT AS deq_n FROM x)
"""


@query(WALK + "SELECT lsn, queue, op, depth FROM y")
def queue_depth(spark, d):
    return queues.walk(the_log(spark, d)).select("lsn", "queue", "op", "depth")


@query(WALK + """, t AS (SELECT lsn, queue, op, deq_n, coalesce(lag(deq_n) OVER (PARTITION BY queue ORDER BY lsn), 0) AS b FROM y)
SELECT t.lsn, t.queue, g.value FROM t LEFT JOIN (SELECT queue, enq_n, value FROM y WHERE op = 'enqueue') g ON t.queue = g.queue AND t.deq_n = g.enq_n AND t.deq_n > t.b WHERE t.op = 'dequeue'""")
def queue_dequeue_match(spark, d):
    return queues.dequeues(the_log(spark, d))


@query(WALK + "SELECT queue, arg_max(depth, lsn) AS depth FROM y GROUP BY queue")
def queue_length(spark, d):
    return queues.depths(the_log(spark, d))


@query(WALK + "SELECT y.queue, enq_n - done AS place, value FROM y JOIN (SELECT queue, max(deq_n) AS done FROM y GROUP BY queue) m ON y.queue = m.queue WHERE op = 'enqueue' AND enq_n > done")
def queue_remaining(spark, d):
    return queues.remaining(the_log(spark, d))


STREAM = ", st AS (SELECT lsn, stream, row_number() OVER (PARTITION BY stream ORDER BY lsn)::BIGINT AS seq, value AS event FROM log WHERE op = 'append_event')\n"


@query(STREAM + "SELECT * FROM st")
def stream_seq(spark, d):
    return streams.sequenced(the_log(spark, d))


@query(STREAM + "SELECT * FROM st WHERE stream = 's3' AND seq > 20 ORDER BY seq LIMIT 50")
def stream_read_after(spark, d):
    return streams.read_after(streams.sequenced(the_log(spark, d)), "s3", 20, 50)


@query(STREAM + "SELECT * FROM st WHERE stream = 's1' AND seq BETWEEN 5 AND 90 ORDER BY seq LIMIT 40")
def stream_xrange(spark, d):
    return streams.read_range(streams.sequenced(the_log(spark, d)), "s1", 5, 90, 40)


@query(STREAM + "SELECT * FROM st WHERE stream = 's1' AND seq BETWEEN 5 AND 90 ORDER BY seq DESC LIMIT 40")
def stream_xrev(spark, d):
    return streams.read_range(streams.sequenced(the_log(spark, d)), "s1", 5, 90, 40, reverse=True)


@query(STREAM + """, r AS (SELECT st.stream, seq, event, row_number() OVER (PARTITION BY st.stream ORDER BY seq) AS p FROM st JOIN (SELECT 's' || i AS stream, i * 10 AS a FROM range(0, 4) t(i)) c ON st.stream = c.stream WHERE seq > a)
SELECT stream, seq, event FROM r WHERE p <= 15""")
def stream_xread(spark, d):
    cursors = spark.range(4).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("stream"), (F.col("id") * 10).alias("after_seq"))
    return streams.read_many(streams.sequenced(the_log(spark, d)), cursors, 15)


@query(STREAM + "SELECT st.lsn, st.stream, floor(log.ts * 1000)::BIGINT || '-' || seq AS id FROM st JOIN log ON st.lsn = log.lsn")
def stream_ids(spark, d):
    log = the_log(spark, d)
    return streams.ids(streams.sequenced(log), log)


@query(STREAM + "SELECT stream, count(*)::BIGINT AS n, max(seq) AS last_seq FROM st GROUP BY stream")
def stream_xlen(spark, d):
    return streams.lengths(streams.sequenced(the_log(spark, d)))


# lists and hashes: views push left, clicks push right, errors pop left, purchases pop right


def list_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "view", "lpush").when(F.col("event_type") == "click", "rpush").when(F.col("event_type") == "error", "lpop").when(F.col("event_type") == "purchase", "rpop")
    return e.select(F.col("event_id").alias("lsn"), F.concat(F.lit("l:"), (F.col("user_id") % 20).cast("string")).alias("key"), op.alias("op"), (F.col("event_id") % 6).cast("string").alias("value")).where("op IS NOT NULL")


LISTS = """
WITH log AS (SELECT event_id AS lsn, 'l:' || user_id % 20 AS key, CASE event_type WHEN 'view' THEN 'lpush' WHEN 'click' THEN 'rpush' WHEN 'error' THEN 'lpop' WHEN 'purchase' THEN 'rpop' END AS op, (event_id % 6)::VARCHAR AS value FROM events),
l AS (SELECT key, list(value ORDER BY CASE WHEN op = 'lpush' THEN -lsn ELSE lsn END) AS items FROM log WHERE op IN ('lpush', 'rpush') GROUP BY key)
"""


def lists(spark, d):
    return structures.pushed(list_log(spark, d))


@query(LISTS + "SELECT key, len(items)::INTEGER AS n, array_to_string(items, ',') AS items FROM l", log=False)
def list_push(spark, d):
    return lists(spark, d).select("key", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


@query(LISTS + "SELECT key, array_to_string(items[len(items) - 9 : len(items) - 2], ',') AS items FROM l", log=False)
def list_range(spark, d):
    return lists(spark, d).select("key", F.array_join(structures.lrange(F.col("items"), -10, -3), ",").alias("items"))


@query(LISTS + "SELECT key, items[3] AS third, items[-1] AS last, items[100000] AS beyond FROM l", log=False)
def list_index(spark, d):
    i = F.col("items")
    return lists(spark, d).select("key", structures.lindex(i, 2).alias("third"), structures.lindex(i, -1).alias("last"), structures.lindex(i, 99999).alias("beyond"))


@query(LISTS + """, u AS (SELECT key, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY key, x ORDER BY i) AS a, row_number() OVER (PARTITION BY key, x ORDER BY i DESC) AS b FROM u)
SELECT key, coalesce(string_agg(x, ',' ORDER BY i) FILTER (WHERE x <> '3'), '') AS none, coalesce(string_agg(x, ',' ORDER BY i) FILTER (WHERE x <> '3' OR a > 2), '') AS head, coalesce(string_agg(x, ',' ORDER BY i) FILTER (WHERE x <> '3' OR b > 2), '') AS tail FROM n GROUP BY key""", log=False)
def list_rem(spark, d):
    rem = lambda n: F.array_join(structures.lrem(F.col("items"), F.lit("3"), n), ",")
    return lists(spark, d).select("key", rem(0).alias("none"), rem(2).alias("head"), rem(-2).alias("tail"))


@query(LISTS + "SELECT key, array_to_string(items[1:1] || ['x'] || items[3:], ',') AS items FROM l WHERE len(items) > 1", log=False)
def list_set(spark, d):
    return lists(spark, d).where(F.size("items") > 1).select("key", F.array_join(structures.lset(F.col("items"), 1, F.lit("x")), ",").alias("items"))


FOLD = """
, r AS (SELECT key, op, value, row_number() OVER (PARTITION BY key ORDER BY lsn) AS n, count(*) OVER (PARTITION BY key) AS most FROM ops),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS n, most, []::VARCHAR[] AS items FROM r
  UNION ALL
  SELECT r.key, r.n, r.most, CASE
    WHEN r.op = 'lpush' OR (r.op = 'lpushx' AND len(f.items) > 0) THEN list_prepend(r.value, f.items)
    WHEN r.op = 'rpush' OR (r.op = 'rpushx' AND len(f.items) > 0) THEN list_append(f.items, r.value)
    WHEN r.op = 'lpop' THEN f.items[2:] WHEN r.op = 'rpop' THEN f.items[:len(f.items) - 1] ELSE f.items END
  FROM f JOIN r ON f.key = r.key AND r.n = f.n + 1)
SELECT key, len(items)::INTEGER AS n, array_to_string(items, ',') AS items FROM f WHERE n = most"""


@query(LISTS + ", ops AS (SELECT * FROM log WHERE op IS NOT NULL)" + FOLD, log=False, recursive=True)
def list_pop(spark, d):
    return structures.folded(list_log(spark, d)).select("key", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


@query(LISTS + ", ops AS (SELECT lsn, key, CASE WHEN lsn % 4 <> 0 AND op IN ('lpush', 'rpush') THEN op || 'x' ELSE op END AS op, value FROM log WHERE op IS NOT NULL)" + FOLD, log=False, recursive=True)
def list_pushx(spark, d):
    only = (F.col("lsn") % 4 != 0) & F.col("op").isin("lpush", "rpush")
    log = list_log(spark, d).withColumn("op", F.when(only, F.concat("op", F.lit("x"))).otherwise(F.col("op")))
    return structures.folded(log).select("key", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


def hash_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "error", "hdel").when(F.col("event_type") == "purchase", "hincrby").otherwise("hset")
    return e.select(F.col("event_id").alias("lsn"), F.concat(F.lit("h:"), (F.col("user_id") % 20).cast("string")).alias("key"), op.alias("op"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("field"), F.floor("value").cast("string").alias("value"))


HASH = """
WITH log AS (SELECT event_id AS lsn, 'h:' || user_id % 20 AS key, CASE event_type WHEN 'error' THEN 'hdel' WHEN 'purchase' THEN 'hincrby' ELSE 'hset' END AS op, 'f' || event_id % 7 AS field, floor(value)::BIGINT::VARCHAR AS value FROM events),
h AS (SELECT key, field, s.value AS value FROM (SELECT key, field, arg_max({'op': op, 'value': value}, lsn) AS s FROM log WHERE op IN ('hset', 'hdel') GROUP BY key, field) WHERE s.op = 'hset')
"""


@query(HASH + "SELECT * FROM h", log=False)
def hash_getall(spark, d):
    return structures.hash_rows(hash_log(spark, d))


@query(HASH + "SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals, count(*)::INTEGER AS n, max(CASE WHEN field = 'f3' THEN value END) AS f3, max(CASE WHEN field = 'f3' THEN 1 ELSE 0 END) = 1 AS has_f3 FROM h GROUP BY key", log=False)
def hash_reads(spark, d):
    f = F.col("fields")
    h = structures.hashes(hash_log(spark, d))
    return h.select("key", F.array_join(F.map_keys(f), ",").alias("fields"), F.array_join(F.map_values(f), ",").alias("vals"), F.size(f).alias("n"), F.try_element_at(f, F.lit("f3")).alias("f3"), F.map_contains_key(f, "f3").alias("has_f3"))


@query(HASH + ", r AS (SELECT lsn, key, field, op, lag(op) OVER (PARTITION BY key, field ORDER BY lsn) AS p FROM log WHERE op IN ('hset', 'hdel')) SELECT lsn, key, field, CASE WHEN p = 'hset' THEN 0 ELSE 1 END AS added FROM r WHERE op = 'hset'", log=False)
def hash_set_added(spark, d):
    return structures.hset_added(hash_log(spark, d))


@query(HASH + "SELECT key, count(*)::INTEGER AS n FROM h WHERE field NOT IN ('f1', 'f2') GROUP BY key", log=False)
def hash_del(spark, d):
    kept = F.map_filter("fields", lambda k, v: ~k.isin("f1", "f2"))
    return structures.hashes(hash_log(spark, d)).select("key", F.size(kept).alias("n")).where("n > 0")


@query(HASH + "SELECT field, value FROM h WHERE key = 'h:3' AND field > 'f0' ORDER BY field LIMIT 4", log=False)
def hash_scan(spark, d):
    return state.scan_page(structures.hash_rows(hash_log(spark, d)).where("key = 'h:3'").select("field", "value"), "f0", "f*", 4, "field")


@query("SELECT 'h:' || user_id % 20 AS key, 'f' || event_id % 7 AS field, regexp_replace(regexp_replace(sum(value::DECIMAL(30, 6))::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2", log=False)
def hash_incrbyfloat(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    return structures.hincrbyfloat(e.select(F.lit("hincrbyfloat").alias("op"), F.concat(F.lit("h:"), (F.col("user_id") % 20).cast("string")).alias("key"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("field"), "value"))


@query(HASH + "SELECT key, field, sum(value::BIGINT)::BIGINT::VARCHAR AS value FROM log WHERE op = 'hincrby' GROUP BY key, field", log=False)
def hash_incrby(spark, d):
    return structures.hincrby(hash_log(spark, d))


@query("SELECT key, string_agg(value, '' ORDER BY lsn) AS text, strlen(string_agg(value, '' ORDER BY lsn))::BIGINT AS bytes FROM log WHERE op = 'put' GROUP BY key")
def string_append_strlen(spark, d):
    return state.strings_after_append(the_log(spark, d))


@query("""
WITH r AS (SELECT event_id AS lsn, 'f:' || user_id % 9 AS key, sum(value::DECIMAL(30, 6)) OVER (PARTITION BY user_id % 9 ORDER BY event_id) AS v FROM events)
SELECT lsn, key, regexp_replace(regexp_replace(v::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS value FROM r""", log=False)
def string_incrbyfloat(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("lsn"), F.concat(F.lit("f:"), (F.col("user_id") % 9).cast("string")).alias("key"), "value")
    return structures.incrbyfloat(e)


@query("SELECT a.key, CASE WHEN kv.value IS NULL THEN 'none' WHEN kv.value LIKE '[%' THEN 'list' WHEN kv.value LIKE '{%' THEN 'hash' ELSE 'string' END AS type FROM ask a LEFT JOIN kv ON a.key = kv.key")
def key_type(spark, d):
    return state.mget(kv(spark, d), ask(spark)).select("key", state.value_type(F.col("value")).alias("type"))


@query("""
, c AS (SELECT pos, key, ['GET', 'LLEN', 'HGET', 'nope'][pos % 4 + 1] AS name, CASE WHEN pos % 9 = 0 THEN 0 ELSE 1 END AS n_args FROM ask),
k AS (SELECT c.*, CASE WHEN kv.value IS NULL THEN 'none' WHEN kv.value LIKE '[%' THEN 'list' WHEN kv.value LIKE '{%' THEN 'hash' ELSE 'string' END AS has FROM c LEFT JOIN kv ON c.key = kv.key)
SELECT pos, CASE WHEN name = 'nope' THEN 'ERR unknown command ' || chr(39) || 'nope' || chr(39) WHEN n_args < 1 THEN 'ERR wrong number of arguments for ' || chr(39) || lower(name) || chr(39) || ' command'
  WHEN has <> 'none' AND has <> CASE name WHEN 'GET' THEN 'string' WHEN 'LLEN' THEN 'list' ELSE 'hash' END THEN 'WRONGTYPE Operation against a key holding the wrong kind of value' END AS error FROM k""")
def command_errors(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("GET", "LLEN", "HGET", "nope"))), (F.col("pos") % 4 + 1).cast("int"))
    return state.type_errors(kv(spark, d), ask(spark).select("pos", "key", name.alias("name"), F.when(F.col("pos") % 9 == 0, 0).otherwise(1).alias("n_args")))


@query("SELECT page_id, regexp_full_match(url, '[A-Za-z0-9_\\-:.]+') AND length(url) <= 1024 AS valid FROM pages", log=False)
def key_validation(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", valid_key(F.col("url")).alias("valid"))
