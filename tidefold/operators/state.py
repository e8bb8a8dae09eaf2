"""Keys and counters: the fold of put, delete and incr rows of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.oplog import live
from tidefold.operators.scans import folded
from tidefold.sources.shared import keep


def by_key():
    return Window.partitionBy("key").orderBy("lsn")


def kv_state(log: DataFrame, as_of: float) -> DataFrame:
    """key, value, expires_at, last_lsn: the last put of each key that is neither deleted nor expired. One shuffle."""
    rows = log.where("op IN ('put', 'delete')")
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "value", "expires_at"), "lsn").alias("s"), F.max("lsn").alias("last_lsn"))
    return last.where("s.op = 'put'").select("key", "s.value", "s.expires_at", "last_lsn").where(live(as_of))


def get(state: DataFrame, keys: DataFrame, default: str | None = None) -> DataFrame:
    """key, value for each row of `keys` (key); `default` only where the entry is absent, not where its value is null."""
    found = state.select("key", F.struct("value").alias("s"))
    return keys.join(found, "key", "left").select("key", F.when(F.col("s").isNull(), F.lit(default)).otherwise(F.col("s.value")).alias("value"))


def mget(state: DataFrame, keys: DataFrame) -> DataFrame:
    """pos, key, value of `keys` (pos, key): one row per position, null for a missing key, repeats allowed."""
    return keys.join(state.select("key", "value"), "key", "left").select("pos", "key", "value")


def exists_count(state: DataFrame, keys: DataFrame) -> DataFrame:
    """n: how many of the rows of `keys` (key) exist, repeats counted."""
    return keys.join(state.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def keys_with_prefix(log: DataFrame, as_of: float, prefix: str) -> DataFrame:
    """key, since: live keys in order of insertion; overwriting keeps a key's place, deleting and adding again moves it."""
    rows = log.where(F.col("op").isin("put", "delete") & F.col("key").startswith(prefix))
    gone = F.max(F.when(F.col("op") == "delete", F.col("lsn"))).over(by_key().rowsBetween(Window.unboundedPreceding, -1))
    first = rows.withColumn("gone", F.coalesce(gone, F.lit(-1))).where("op = 'put'").groupBy("key", "gone").agg(F.min("lsn").alias("since"))
    first = first.groupBy("key").agg(F.max_by("since", "gone").alias("since"))
    return kv_state(rows, as_of).select("key").join(first, "key")


def glob(pattern: str) -> str:
    """A regular expression for *, ? and [...]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "[" and end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c)
        i += 1
    return f"^{out}$"


def keys_matching(state: DataFrame, pattern: str) -> DataFrame:
    """Live keys that the whole pattern matches; its literal start is pushed down as a prefix."""
    literal = pattern[: min([pattern.find(c) for c in "*?[" if c in pattern], default=len(pattern))]
    return state.where(F.col("key").startswith(literal) & F.col("key").rlike(glob(pattern))).select("key")


def ttl(state: DataFrame, as_of: float, keys: DataFrame) -> DataFrame:
    """key, ttl: null for an absent key, -1 for one without expiry, else the seconds left."""
    found = state.select("key", F.when(F.col("expires_at").isNull(), -1.0).otherwise(F.greatest(F.col("expires_at") - F.lit(as_of), F.lit(0.0))).alias("ttl"))
    return keys.join(found, "key", "left").select("key", "ttl")


def ttl_seconds(state: DataFrame, as_of: float, keys: DataFrame) -> DataFrame:
    """The wire form: whole seconds, -1 without expiry, -2 for an absent key."""
    return ttl(state, as_of, keys).select("key", F.coalesce(F.col("ttl").cast("long"), F.lit(-2)).alias("ttl"))


def counters(log: DataFrame, start: str = "0") -> DataFrame:
    """lsn, key, counter: each incr's result. A put sets the base (its value if that is a whole number) and a delete
    clears it; within such a segment the amounts run up. Windows only."""
    rows = log.where("op IN ('put', 'delete', 'incr')")
    segment = F.count(F.when(F.col("op") != "incr", 1)).over(by_key())
    rows = rows.withColumn("segment", segment)
    within = Window.partitionBy("key", "segment").orderBy("lsn")
    base = F.when(F.col("op") == "put", F.expr("try_cast(value AS BIGINT)")).when(F.col("op") == "incr", F.col("amount")).otherwise(F.lit(0))
    return rows.withColumn("counter", F.sum(F.coalesce(base, F.lit(0))).over(within)).where("op = 'incr'").select("lsn", "key", "counter")


def counter_state(log: DataFrame) -> DataFrame:
    """key, counter, n: last values by key of a log of increments alone, one partial aggregation."""
    return log.where("op = 'incr'").groupBy("key").agg(F.sum("amount").alias("counter"), F.count(F.lit(1)).alias("n"))


def getset(log: DataFrame) -> DataFrame:
    """lsn, key, old: what each put replaced, null after a delete or at first."""
    rows = log.where("op IN ('put', 'delete')")
    before = F.lag(F.struct("op", "value")).over(by_key())
    return rows.withColumn("p", before).where("op = 'put'").select("lsn", "key", F.when(F.col("p.op") == "put", F.col("p.value")).alias("old"))


def deletes(log: DataFrame) -> DataFrame:
    """lsn, key, existed: 1 where a delete found its key."""
    rows = log.where("op IN ('put', 'delete')").withColumn("p", F.lag("op").over(by_key()))
    return rows.where("op = 'delete'").select("lsn", "key", F.when(F.col("p") == "put", 1).otherwise(0).alias("existed"))


def set_if_absent(log: DataFrame) -> DataFrame:
    """lsn, key, done: puts as SET NX; of those between two deletes of a key the first is done."""
    rows = log.where("op IN ('put', 'delete')").withColumn("segment", F.count(F.when(F.col("op") == "delete", 1)).over(by_key()))
    puts = rows.where("op = 'put'")
    first = F.row_number().over(Window.partitionBy("key", "segment").orderBy("lsn")) == 1
    return puts.select("lsn", "key", first.cast("int").alias("done"))


def mset(commands: DataFrame) -> DataFrame:
    """Log rows of MSET commands (lsn, mapping map<string,string>), in order of the keys, and n, the reply to each."""
    n = F.size("mapping")
    return commands.select("lsn", n.alias("n"), F.explode("mapping").alias("key", "value"))


def mincr(commands: DataFrame) -> DataFrame:
    """lsn, key, counter: MINCR commands (lsn, updates array<struct<key,amount>>) answer each key with its last value;
    a key that comes twice in a command adds up."""
    rows = commands.select("lsn", F.posexplode("updates").alias("pos", "u")).select("lsn", "pos", "u.key", "u.amount")
    run = F.sum("amount").over(Window.partitionBy("key").orderBy("lsn", "pos"))
    return rows.withColumn("counter", run).groupBy("lsn", "key").agg(F.max_by("counter", "pos").alias("counter"))


def value_type(value: Column) -> Column:
    """string, list or hash by the value's JSON form; none where there is no value."""
    return F.when(value.isNull(), "none").when(value.rlike(r"^\s*\["), "list").when(value.rlike(r"^\s*\{"), "hash").otherwise("string")


#: What kind of value each command works on.
WORKS_ON = {"GET": "string", "APPEND": "string", "INCR": "string", "LPUSH": "list", "LLEN": "list", "LRANGE": "list", "HSET": "hash", "HGET": "hash", "HLEN": "hash"}


def type_errors(state: DataFrame, commands: DataFrame) -> DataFrame:
    """pos, error of `commands` (pos, name, key, n_args): null where a command may run; else the reply that it is unknown,
    lacks its key, or meets a key of another kind. Errors are values: the other commands go on."""
    kinds = F.create_map(*[F.lit(x) for kv in WORKS_ON.items() for x in kv])
    wanted, has = F.try_element_at(kinds, F.upper("name")), value_type(F.col("value"))
    found = commands.join(state.select("key", "value"), "key", "left")
    error = (
        F.when(wanted.isNull(), F.concat(F.lit("ERR unknown command '"), "name", F.lit("'")))
        .when(F.col("n_args") < 1, F.concat(F.lit("ERR wrong number of arguments for '"), F.lower("name"), F.lit("' command")))
        .when((has != "none") & (has != wanted), "WRONGTYPE Operation against a key holding the wrong kind of value")
    )
    return found.select("pos", error.alias("error"))


def rename(state: DataFrame, old: str, new: str) -> DataFrame:
    """key, value, expires_at after RENAME: the time to live is lost; renaming to itself deletes; a missing key is an error."""
    if not state.where(F.col("key") == old).limit(1).count():
        raise KeyError(old)
    moved = state.where(F.col("key") == old).select(F.lit(new).alias("key"), "value", F.lit(None).cast("double").alias("expires_at"))
    rest = state.where(~F.col("key").isin(old, new)).select("key", "value", "expires_at")
    return rest if old == new else rest.unionByName(moved)


def expire(state: DataFrame, changes: DataFrame, as_of: float) -> DataFrame:
    """key, value, expires_at after EXPIRE (seconds) or PERSIST (null seconds) of `changes` (key, seconds)."""
    c = changes.select("key", F.struct("seconds").alias("c"))
    at = F.when(F.col("c").isNull(), F.col("expires_at")).otherwise(F.lit(as_of) + F.col("c.seconds"))
    return state.join(c, "key", "left").select("key", "value", at.alias("expires_at")).where(live(as_of))


def strings_after_append(log: DataFrame) -> DataFrame:
    """key, text, bytes: the values of each key's puts appended in order, and the length in UTF-8 bytes."""
    parts = log.where("op = 'put'").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lsn", "value"))).alias("p"))
    text = F.array_join(F.col("p.value"), "")
    return parts.select("key", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))


def ttl_counters(log: DataFrame) -> DataFrame:
    """key, lsn, counter: increments with expiry between commands. What an increment finds depends on the running
    expiry, so each key's rows are folded in order; an increment without expiry keeps the one there is."""

    def step(state: list, r: dict):
        if state[1] is not None and state[1] <= r["ts"]:
            state[:] = [None, None]
        if r["op"] == "delete":
            state[:] = [None, None]
            return None
        state[:] = [(state[0] or 0) + r["amount"], r["expires_at"] if r["expires_at"] is not None else state[1]]
        return r["key"], r["lsn"], state[0]

    rows = log.where("op IN ('incr', 'delete')").select("key", "lsn", "ts", "op", "amount", "expires_at")
    return folded(rows, "key", ["lsn"], lambda: [None, None], step, "key string, lsn long, counter long")


def getdel(log: DataFrame) -> DataFrame:
    """lsn, key, old: what each delete, as GETDEL, returns; null where it finds nothing."""
    rows = log.where("op IN ('put', 'delete')").withColumn("p", F.lag(F.struct("op", "value")).over(by_key()))
    return rows.where("op = 'delete'").select("lsn", "key", F.when(F.col("p.op") == "put", F.col("p.value")).alias("old"))


def mset_if_absent(commands: DataFrame, rounds: int = 1000) -> DataFrame:
    """lsn, done of MSETNX commands (lsn, mapping): 1 where none of a command's keys existed, and so all were set.

    In each round the commands that come first for all their keys are done, and all others that share a key with one of
    them are not; rounds are few, and each is joins and aggregations."""
    rows = keep(commands.select("lsn", F.explode(F.map_keys("mapping")).alias("key")).distinct())
    left, done = rows, commands.select("lsn").limit(0)
    for _ in range(rounds):
        if not left.limit(1).count():
            break
        first = left.groupBy("key").agg(F.min("lsn").alias("first"))
        chosen = left.join(first, "key").groupBy("lsn").agg(F.bool_and(F.col("lsn") == F.col("first")).alias("all")).where("all").select("lsn")
        taken = keep(left.join(chosen, "lsn", "left_semi"))
        done = done.unionAll(taken.select("lsn").distinct())
        lost = left.join(taken.select("key").distinct(), "key", "left_semi").select("lsn").distinct()
        left = keep(left.join(lost, "lsn", "left_anti"))
    else:
        raise RuntimeError(f"commands did not settle in {rounds} rounds")
    return commands.select("lsn").join(done.withColumn("done", F.lit(1)), "lsn", "left").select("lsn", F.coalesce("done", F.lit(0)).alias("done"))


def ttl_millis(state: DataFrame, as_of: float, keys: DataFrame) -> DataFrame:
    """ttl_seconds() in milliseconds."""
    return ttl(state, as_of, keys).select("key", F.coalesce(F.when(F.col("ttl") < 0, F.lit(-1)).otherwise(F.floor(F.col("ttl") * 1000)).cast("long"), F.lit(-2)).alias("ttl"))


def expire_millis(state: DataFrame, changes: DataFrame, as_of: float) -> DataFrame:
    """expire() with milliseconds: `changes` (key, millis)."""
    return expire(state, changes.select("key", (F.col("millis") / 1000).alias("seconds")), as_of)


def scan_page(rows: DataFrame, cursor: str | None = None, pattern: str = "*", count: int = 10, by: str = "key") -> DataFrame:
    """A page of SCAN or HSCAN: the first `count` rows behind the cursor in order of `by` whose name matches. The last
    row's name is the next cursor; a page that isn't full is the last."""
    if count <= 0:
        raise ValueError("count must be above 0")
    behind = rows if cursor is None else rows.where(F.col(by) > cursor)
    return behind.where(F.col(by).rlike(glob(pattern))).orderBy(by).limit(count)


def stats(log: DataFrame, as_of: float) -> DataFrame:
    """One row: live keys, non-empty queues and streams, records."""
    from tidefold.operators import queues

    k = kv_state(log, as_of).agg(F.count(F.lit(1)).alias("keys"))
    q = queues.depths(log).where("depth > 0").agg(F.count(F.lit(1)).alias("queues"))
    s = log.where("op = 'append_event'").agg(F.count_distinct("stream").alias("streams"))
    n = log.agg(F.count(F.lit(1)).alias("records"))
    return n.select("records", k.scalar().alias("keys"), q.scalar().alias("queues"), s.scalar().alias("streams"))
