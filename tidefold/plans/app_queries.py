"""Queries of the customer, report, statistics, limit and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import udfs
from tidefold.functions.text import epoch_seconds, sanitise, slugify
from tidefold.operators import crm, limits, reports
from tidefold.sources import files
from tidefold.streaming import online

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CRM = """
WITH c AS (
  SELECT c_custkey AS customer_id, lower(c_name || '@example.com') AS email, ['pro', 'team', 'enterprise', 'trial'][c_custkey % 4 + 1] AS plan, lower(c_mktsegment) AS segment,
         [lower(n_name), CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'creditor' END] AS tags, CASE WHEN c_custkey % 3 <> 0 THEN 'sub_' || c_custkey ELSE '' END AS subscription_id, c_custkey AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (
  SELECT o_custkey AS customer_id, 'Owner' || o_custkey || '@Example.com' AS email, ['pro', 'team', 'enterprise'][o_custkey % 3 + 1] AS plan, max(o_orderkey) AS updated_at,
         count(*) AS n_keys, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_active FROM orders GROUP BY o_custkey)
"""


def customers(spark, d):
    return crm.customers_from(t(spark, d, "customer"), t(spark, d, "nation"))


def registry(spark, d):
    return crm.registry_from(t(spark, d, "orders"))


@query(CRM + "SELECT customer_id, email, plan, segment FROM c WHERE email = lower('Customer#000000042@example.com')")
def crm_by_email(spark, d):
    return crm.by_email(customers(spark, d), "Customer#000000042@Example.com").select("customer_id", "email", "plan", "segment")


UPDATES = "WITH u AS (SELECT o_orderkey AS lsn, o_custkey AS customer_id, ['pro', 'team', 'enterprise'][o_orderkey % 3 + 1] AS plan, o_orderstatus AS status FROM orders)\n"


def updates(spark, d):
    plan = F.element_at(F.array(*map(F.lit, crm.PLANS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("customer_id"), plan.alias("plan"), F.col("o_orderstatus").alias("status"))


@query(UPDATES + "SELECT customer_id, arg_max(plan, lsn) AS plan, arg_max(status, lsn) AS status, min(lsn) AS created, max(lsn) AS updated, count(*)::BIGINT AS versions FROM u GROUP BY customer_id")
def crm_update(spark, d):
    return crm.current_customers(updates(spark, d))


@query(UPDATES + "SELECT customer_id, min(lsn) AS created FROM u WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) GROUP BY customer_id ORDER BY created LIMIT 100")
def crm_list_all(spark, d):
    return crm.list_all(updates(spark, d), t(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("customer_id")), 100)


@query("""
WITH log AS (SELECT event_id AS lsn, user_id AS customer_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, CASE event_type WHEN 'signup' THEN 'set' ELSE 'verify' END AS op, sha256((CASE event_type WHEN 'signup' THEN event_id ELSE event_id + user_id END % 3)::VARCHAR) AS hash FROM events WHERE event_type IN ('signup', 'click')),
s AS (SELECT *, last_value(CASE WHEN op = 'set' THEN {'at': lsn, 'hash': hash, 'until': ts + 864000} END IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS c FROM log),
f AS (SELECT *, coalesce(c.hash = hash AND ts <= c.until, false) AS fits FROM s WHERE op = 'verify')
SELECT lsn, customer_id, fits AND NOT coalesce(bool_or(fits) OVER (PARTITION BY customer_id, c.at ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ok FROM f""")
def crm_access_codes(spark, d):
    e = t(spark, d, "events").where("event_type IN ('signup', 'click')")
    ts, first = epoch_seconds(F.col("ts")), F.col("event_type") == "signup"
    code = F.when(first, F.col("event_id")).otherwise(F.col("event_id") + F.col("user_id")) % 3
    return crm.access_codes(e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("customer_id"), ts.alias("ts"), F.when(first, "set").otherwise("verify").alias("op"), code.cast("string").alias("code"), (ts + 864000).alias("expires_at")))


@query("SELECT user_id AS customer_id, (event_id % 4)::BIGINT AS artifact, count(*)::BIGINT AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def crm_artifacts(spark, d):
    e = t(spark, d, "events").where("event_type = 'view'")
    return crm.artifact_issues(e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("customer_id"), (F.col("event_id") % 4).alias("artifact")))


@query(CRM + "SELECT tag, count(*)::BIGINT AS n, string_agg(customer_id::VARCHAR, ',' ORDER BY customer_id) AS customers FROM (SELECT customer_id, unnest(tags) AS tag FROM c) GROUP BY tag")
def crm_tags_index(spark, d):
    return crm.tag_index(customers(spark, d)).withColumn("customers", F.array_join(F.transform("customers", lambda x: x.cast("string")), ","))


@query(CRM + "SELECT customer_id, email FROM c WHERE list_contains(tags, 'debtor')")
def crm_with_tag(spark, d):
    return crm.with_tag(customers(spark, d), "Debtor").select("customer_id", "email")


@query(CRM + "SELECT segment, count(*)::BIGINT AS n, min(customer_id) AS first, max(customer_id) AS last FROM c GROUP BY segment")
def crm_segments(spark, d):
    return crm.segments(customers(spark, d))


@query("""
WITH ch AS (SELECT event_id AS lsn, user_id AS customer_id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, event_type AS x, lower('Tag' || event_id % 4) AS tag FROM events WHERE event_type IN ('error', 'click')),
l AS (SELECT customer_id, tag, arg_max(op, lsn) AS op FROM ch GROUP BY customer_id, tag)
SELECT customer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM l WHERE op = 'add' GROUP BY customer_id""")
def crm_tag_changes(spark, d):
    e = t(spark, d, "events").where("event_type IN ('error', 'click')")
    ch = e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("customer_id"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), F.concat(F.lit("Tag"), (F.col("event_id") % 4).cast("string")).alias("tag"))
    return crm.tags_after(ch).withColumn("tags", F.array_join("tags", ","))


@query(CRM + "SELECT customer_id, array_to_string(CASE WHEN customer_id % 10 = 0 THEN list_append(tags, 'deleted') ELSE tags END, ',') AS tags FROM c")
def crm_soft_delete(spark, d):
    return crm.soft_delete(customers(spark, d), F.col("customer_id") % 10 == 0).select("customer_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_custkey AS customer_id, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS ltv, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'idle' END, o_orderkey) AS status FROM orders GROUP BY 1")
def crm_ltv(spark, d):
    syncs = t(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("lsn"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("idle").alias("status"), F.col("o_totalprice").alias("mrr"))
    return crm.lifetime_value(syncs)


@query("SELECT user_id AS customer_id, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS api_calls, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS compressed_bytes FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def crm_usage(spark, d):
    e = t(spark, d, "events").where("event_type IN ('click', 'view')")
    return crm.usage(e.select(F.col("user_id").alias("customer_id"), F.when(F.col("event_type") == "click", "api_calls").otherwise("compressed_bytes").alias("metric"), F.floor("value").cast("long").alias("amount")))


@query(CRM + """, n AS (SELECT user_id AS customer_id, event_id // 3 AS note_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS resolved FROM events GROUP BY 1, 2)
SELECT c.customer_id, count(n.note_id)::INTEGER AS n_notes, count(n.note_id) FILTER (WHERE resolved = 0)::INTEGER AS n_open FROM c LEFT JOIN n ON c.customer_id = n.customer_id GROUP BY 1""")
def crm_notes(spark, d):
    e = t(spark, d, "events")
    log = e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("customer_id"), F.floor(F.col("event_id") / 3).alias("note_id"), F.when(F.col("event_type") == "error", "resolve").otherwise("add").alias("op"), F.col("props").alias("text"))
    return crm.notes(customers(spark, d), log)


@query("SELECT lower('Lead' || user_id || '@x.org') AS email, min(event_id) AS lsn, count(*)::BIGINT AS n FROM events WHERE event_type = 'signup' GROUP BY 1")
def crm_leads(spark, d):
    e = t(spark, d, "events").where("event_type = 'signup'")
    return crm.leads(e.select(F.concat(F.lit("Lead"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("email"), F.col("event_id").alias("lsn")))


@query(CRM + """SELECT (SELECT count(*) FROM r)::BIGINT AS customers, (SELECT sum(n_keys) FROM r)::BIGINT AS api_keys, count(*)::BIGINT AS db_customers, count(*) FILTER (WHERE subscription_id <> '')::BIGINT AS active,
  count(*) FILTER (WHERE plan = 'pro')::BIGINT AS plan_pro, count(*) FILTER (WHERE plan = 'team')::BIGINT AS plan_team, count(*) FILTER (WHERE plan = 'enterprise')::BIGINT AS plan_enterprise, count(*) FILTER (WHERE plan NOT IN ('pro', 'team', 'enterprise'))::BIGINT AS plan_other FROM c""")
def admin_summary(spark, d):
    return crm.admin_summary(registry(spark, d), customers(spark, d))


@query(CRM + "SELECT p.plan, (SELECT count(*) FROM c WHERE CASE WHEN c.plan IN ('pro', 'team', 'enterprise') THEN c.plan ELSE 'other' END = p.plan)::BIGINT AS n FROM (SELECT unnest(['pro', 'team', 'enterprise', 'other']) AS plan) p")
def admin_plan_breakdown(spark, d):
    return crm.plan_breakdown(customers(spark, d))


@query(CRM + "SELECT customer_id, lower(email) AS email, plan, updated_at, 'registry' AS origin FROM r UNION ALL SELECT customer_id, email, plan, updated_at, 'db' FROM c WHERE email NOT IN (SELECT lower(email) FROM r)")
def admin_merge_customers(spark, d):
    return crm.merged(registry(spark, d), customers(spark, d))


@query("SELECT o_custkey AS customer_id, 'Owner' || o_custkey || '@Example.com' AS email, ['pro', 'team', 'enterprise'][o_custkey % 3 + 1] AS plan, o_orderkey AS key_id, o_orderkey AS created_at, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey + 1 END AS revoked_at FROM orders")
def admin_explode_keys(spark, d):
    return crm.api_keys(registry(spark, d))


@query(CRM + "SELECT customer_id, n_active::INTEGER AS active, n_active < 5 AS can_create FROM r")
def registry_active_keys(spark, d):
    return crm.active_keys(registry(spark, d), 5)


@query("SELECT p_type AS price_id, 'pro' AS plan, 1 AS max_keys FROM part WHERE false UNION ALL SELECT DISTINCT x, CASE WHEN x LIKE '%enterprise%' THEN 'enterprise' WHEN x LIKE '%team%' THEN 'team' ELSE 'pro' END, CASE WHEN x LIKE '%enterprise%' THEN 10 WHEN x LIKE '%team%' THEN 5 ELSE 1 END FROM (SELECT 'price_' || ['pro', 'team', 'enterprise', 'x'][p_partkey % 4 + 1] || '_' || p_size AS x FROM part)")
def plan_mapping(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("pro", "team", "enterprise", "x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return crm.entitlements(t(spark, d, "part").select(F.concat(F.lit("price_"), name, F.lit("_"), F.col("p_size").cast("string")).alias("price_id")).distinct())


CORPUS = """
WITH a AS (SELECT page_id AS id, url AS endpoint FROM pages), u AS (SELECT event_id AS id, '/' || event_type || '/' || user_id % 10 AS endpoint FROM events),
x AS (SELECT id, endpoint, 'access' AS origin FROM a UNION ALL SELECT id, endpoint, 'usage' FROM u WHERE endpoint LIKE '/click/%' OR endpoint LIKE '/view/1%')
"""


def expanded(spark, d):
    access = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("endpoint"))
    usage = t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), (F.col("user_id") % 10).cast("string")).alias("endpoint"))
    return reports.expanded_corpus(access, usage, ["/click/", "/view/1"])


@query(CORPUS + "SELECT * FROM x")
def corpus_union_filter(spark, d):
    return expanded(spark, d)


@query(CORPUS + "SELECT endpoint, count(*)::BIGINT AS n FROM x GROUP BY endpoint")
def corpus_endpoint_counts(spark, d):
    return expanded(spark, d).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS path, lang AS class, count(*)::BIGINT AS n FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'fr') GROUP BY 1, 2")
def corpus_selection(spark, d):
    s = t(spark, d, "documents").select(F.col("source").alias("path"), F.col("lang").alias("class"))
    return reports.selected(s, ["src1", "src2"], ["en", "fr"]).groupBy("path", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS sources, count(*) FILTER (WHERE doc_id % 5 <> 0)::BIGINT AS present, sum(strlen(text)) FILTER (WHERE doc_id % 5 <> 0)::BIGINT AS bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1) FILTER (WHERE doc_id % 5 <> 0)::BIGINT AS lines FROM documents")
def manifest_totals(spark, d):
    there = F.col("doc_id") % 5 != 0
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return reports.manifest_totals(t(spark, d, "documents").select(there.alias("exists"), F.when(there, F.octet_length("text")).alias("bytes"), F.when(there, lines).alias("lines")))


@query()
def manifest_hash(spark, d):
    return files.lock_manifest(spark, d, "*.parquet").select("name", "exists", "bytes", "sha256")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'slice' ELSE s END AS slug FROM (SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM pages)")
def slugs(spark, d):
    return t(spark, d, "pages").select("page_id", slugify(F.col("url")).alias("slug"))


@query("SELECT c_custkey, substr(c_name, 1, 400) AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer")
def metadata_sanitise(spark, d):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    clean = t(spark, d, "customer").select("c_custkey", sanitise(m).alias("m"))
    return clean.select("c_custkey", F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("segment")).alias("segment"))


@query("SELECT source AS report, count(*)::BIGINT AS n, count(*) FILTER (WHERE doc_id % 5 <> 0)::BIGINT AS passed, count(*) FILTER (WHERE doc_id % 5 = 0)::BIGINT AS failed, CASE WHEN count(*) FILTER (WHERE doc_id % 5 = 0) = 0 THEN 'complete' WHEN count(*) FILTER (WHERE doc_id % 5 <> 0) = 0 THEN 'missing' ELSE 'partial' END AS status FROM documents GROUP BY ROLLUP (source)")
def status_rollup(spark, d):
    return reports.status_rollup(t(spark, d, "documents").select(F.col("source").alias("report"), F.col("lang").alias("check"), (F.col("doc_id") % 5 != 0).alias("ok")))


@query()
def codec_matrix(spark, d):
    """Plain and byte-shuffled vectors under each codec: sizes, ratio, and whether the bytes come back."""
    raw = t(spark, d, "embeddings").select(udfs.as_float_bytes("embedding").alias("raw"))
    blobs = raw.select(F.explode(F.create_map(F.lit("plain"), "raw", F.lit("shuffled"), udfs.byte_shuffle("raw"))).alias("name", "content"))
    rows = reports.codec_report(blobs, ["none", "zlib-6", "gzip-9"]).groupBy("name", "codec").agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.bool_and("lossless").alias("lossless"))
    return rows.withColumn("ratio", F.round(F.col("in_bytes") / F.greatest("out_bytes", F.lit(1)), 4))


@query()
def codec_report(spark, d):
    blobs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    return reports.codec_totals(reports.codec_report(blobs, ["gzip-9", "zlib-6"]))


MODES = """
WITH s AS (SELECT source AS class, mode, rank, sum(bytes)::BIGINT AS bytes FROM (
  SELECT source, unnest(['gzip', 'lower', 'words']) AS mode, unnest([0, 1, 2]) AS rank, unnest([strlen(text), strlen(lower(text)), len(regexp_extract_all(text, '[^ ]+'))]) AS bytes FROM documents) GROUP BY 1, 2, 3)
"""


@query(MODES + "SELECT class, b.mode AS mode, b.bytes AS bytes, b.bytes - g AS delta FROM (SELECT class, arg_min({'mode': mode, 'bytes': bytes}, (bytes, rank)) AS b, max(CASE WHEN mode = 'gzip' THEN bytes END) AS g FROM s GROUP BY class)")
def slice_best_mode(spark, d):
    x = lambda m, r, b: F.struct(F.lit(m).alias("mode"), F.lit(r).alias("rank"), b.cast("long").alias("bytes"))
    modes = F.array(x("gzip", 0, F.octet_length("text")), x("lower", 1, F.octet_length(F.lower("text"))), x("words", 2, F.regexp_count("text", F.lit("[^ ]+"))))
    rows = t(spark, d, "documents").select(F.col("source").alias("class"), F.explode(modes).alias("m")).groupBy("class", "m.mode", "m.rank").agg(F.sum("m.bytes").alias("bytes"))
    return reports.best_mode(rows)


@query("SELECT arg_max(l_returnflag || l_linestatus, r) AS best_ratio, arg_max(l_returnflag || l_linestatus, q) AS best_decode, arg_max(l_returnflag || l_linestatus, r * q) AS best_balance FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS r, sum(l_linenumber)::DOUBLE AS q FROM lineitem GROUP BY 1, 2)")
def codec_winners(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("profile")).agg(F.count(F.lit(1)).cast("double").alias("ratio"), F.sum("l_linenumber").cast("double").alias("decode"))
    return reports.winners(rows)


TOK = "list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: [x] || list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: substr(x, i, 3)))))"


@query(f"""
WITH k AS (SELECT conv_id, turn, {TOK} AS w FROM conversations WHERE role = 'user'),
s AS (SELECT a.conv_id, a.turn, b.conv_id AS memory_conv, b.turn AS memory_turn, len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS score FROM k a, k b WHERE a.conv_id >= 40 AND b.conv_id < 40 AND len(a.w) > 0 AND len(b.w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, memory_conv, memory_turn)::INTEGER AS rank FROM s WHERE score >= 0.2)
SELECT conv_id, turn, rank, memory_conv, memory_turn, round(score, 6) AS score FROM r WHERE rank <= 3""")
def memory_topk_threshold(spark, d):
    turns = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return reports.memory_matches(turns, 40, 3, 0.2).withColumn("score", F.round("score", 6))


STAT = "WITH v AS (SELECT l_returnflag AS g, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1)\n"


@query(STAT + "SELECT g, len(v)::BIGINT AS n, v[1] AS min, v[round_even(0.5 * (len(v) - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::BIGINT + 1] AS p95, v[round_even(0.99 * (len(v) - 1), 0)::BIGINT + 1] AS p99, v[-1] AS max FROM v")
def stat_percentiles_nearest(spark, d):
    return reports.series_summary(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice"), ["g"], "l_extendedprice")


@query("SELECT l_returnflag AS g, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1")
def stat_median(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.percentile("l_extendedprice", 0.5), 6).alias("median"))


@query(STAT + """, p AS (SELECT g, v, len(v) AS n, 0.95 * (len(v) + 1) AS a, 0.99 * (len(v) + 1) AS b FROM v),
l AS (SELECT *, greatest(1, least(n - 1, floor(a)::BIGINT)) AS i, greatest(1, least(n - 1, floor(b)::BIGINT)) AS j FROM p)
SELECT g, round(v[i] + (a - i) * (v[i + 1] - v[i]), 6) AS p95, round(v[j] + (b - j) * (v[j + 1] - v[j]), 6) AS p99 FROM l""")
def stat_quantiles_exclusive(spark, d):
    s = reports.exclusive_quantiles(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice"), ["g"], "l_extendedprice", (95, 99))
    return s.select("g", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query("SELECT l_linestatus, sum(l_linenumber)::BIGINT AS ops, round(sum(l_tax), 6) AS seconds, round(sum(l_linenumber) / sum(l_tax), 6) AS rate FROM lineitem GROUP BY 1")
def stat_throughput(spark, d):
    rows = t(spark, d, "lineitem").select("l_linestatus", F.col("l_linenumber").cast("long").alias("logical_ops"), F.col("l_tax").alias("seconds"))
    return reports.throughput(rows, ["l_linestatus"]).withColumn("seconds", F.round("seconds", 6)).withColumn("rate", F.round("rate", 6))


MODE_RATES = "WITH m AS (SELECT l_returnflag || l_linestatus AS mode, count(*)::BIGINT AS ops, sum(l_tax) AS seconds, sum(l_linenumber)::BIGINT AS raw, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY 1)\n"


def mode_rates(spark, d):
    c = F.col
    rows = t(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), F.lit(1).cast("long").alias("ops"), c("l_tax").alias("seconds"), c("l_linenumber").cast("long").alias("raw_bytes"), c("l_quantity").cast("long").alias("bytes"))
    return reports.mode_rates(rows)


@query(MODE_RATES + "SELECT mode, ops, round(ops / seconds, 6) AS rate, bytes, round(raw / bytes, 6) AS ratio FROM m")
def stat_mode_rates(spark, d):
    return mode_rates(spark, d).withColumn("rate", F.round("rate", 6)).withColumn("ratio", F.round("ratio", 6))


@query(MODE_RATES + "SELECT a.mode, b.mode AS other, round((a.ops / a.seconds) / (b.ops / b.seconds), 6) AS speedup FROM m a JOIN m b ON a.mode < b.mode")
def stat_mode_speedups(spark, d):
    return reports.mode_speedups(mode_rates(spark, d)).withColumn("speedup", F.round("speedup", 6))


@query("""
WITH v AS (SELECT event_type AS bench, list(value ORDER BY value) FILTER (WHERE event_id % 10 <> 0) AS v, count(*)::BIGINT AS n, count(*) FILTER (WHERE event_id % 10 = 0)::BIGINT AS errors, sum(value) FILTER (WHERE event_id % 10 <> 0) AS s FROM events GROUP BY 1)
SELECT bench, n, errors, round(len(v) / s, 6) AS rate, v[round_even(0.5 * (len(v) - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::BIGINT + 1] AS p95, v[round_even(0.99 * (len(v) - 1), 0)::BIGINT + 1] AS p99 FROM v""")
def stat_wire_summary(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("bench"), F.col("value").alias("latency"), (F.col("event_id") % 10 != 0).alias("ok"))
    return reports.wire_summary(rows).withColumn("rate", F.round("rate", 6))


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'none') AS reason, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stat_reason_counts(spark, d):
    return reports.reason_counts(t(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("r")), "r")


@query("""
WITH n AS (SELECT o_orderpriority AS name, count(*)::BIGINT AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS name, count(*)::BIGINT AS w FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT n.name, v - w AS delta, round((v - w) / w * 100, 3) AS percent, CASE WHEN w IS NULL OR w = 0 THEN 'n/a' WHEN v = w THEN 'same' WHEN v > w THEN 'improved' ELSE 'regressed' END AS verdict FROM n LEFT JOIN b ON n.name = b.name""")
def stat_delta(spark, d):
    o = t(spark, d, "orders")
    count = lambda df: df.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("v"))
    return reports.deltas(count(o.where("o_orderstatus = 'F'")), count(o.where("o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")), "name", "v")


@query("""
WITH p AS (SELECT l_linestatus AS operation, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS ra, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS rr, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS la, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS lr FROM lineitem GROUP BY 1)
SELECT operation, round(ra / rr, 6) AS speedup, round((1 - la / lr) * 100, 6) AS latency_gain, CASE WHEN ra / rr >= 1 THEN 'A' ELSE 'R' END AS winner FROM p""")
def competitor_summary(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("operation"), F.col("l_quantity").alias("rate"), F.col("l_extendedprice").alias("latency"))
    return reports.competitor_summary(rows, "A", "R")


@query("SELECT p_partkey AS scale, p_retailprice / 1000 AS speedup_vs_exact, p_size / 50.0::DOUBLE AS recall_at_k FROM part WHERE p_retailprice / 1000 >= 0.95 AND (p_partkey % 10) / 10.0::DOUBLE >= 0.5 AND p_size / 50.0::DOUBLE >= 0.6")
def qualification_filter(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("scale"), (F.col("p_retailprice") / 1000).alias("speedup_vs_exact"), (F.col("p_partkey") % 10 / 10.0).alias("top1_match_rate"), (F.col("p_size") / 50.0).alias("recall_at_k"))
    return reports.qualified(rows, 0.95, 0.5, 0.6).drop("top1_match_rate")


def calls(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), epoch_seconds(F.col("ts")).alias("ts"))


@query("""
WITH c AS (SELECT event_id AS id, user_id::VARCHAR AS key, epoch_us(ts) / 1000000.0::DOUBLE AS ts FROM events), b AS (SELECT *, (floor(ts / 86400) * 86400)::BIGINT AS bucket FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY key, bucket ORDER BY ts, id) AS n FROM b)
SELECT id, key, bucket, n <= 2 AS allowed, greatest(2 - n, 0)::INTEGER AS remaining FROM n""")
def rate_limit_fixed(spark, d):
    return limits.fixed(calls(spark, d), 86400, 2)


@query("""
WITH RECURSIVE c AS (SELECT event_id AS id, user_id::VARCHAR AS key, epoch_us(ts) / 1000000.0::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT DISTINCT NULL::BIGINT AS id, key, 0::BIGINT AS n, false AS allowed, []::DOUBLE[] AS held FROM c
  UNION ALL
  SELECT c.id, c.key, c.n, len(list_filter(f.held, lambda x: x > c.ts - 86400)) < 2,
         CASE WHEN len(list_filter(f.held, lambda x: x > c.ts - 86400)) < 2 THEN list_append(list_filter(f.held, lambda x: x > c.ts - 86400), c.ts) ELSE list_filter(f.held, lambda x: x > c.ts - 86400) END
  FROM f JOIN c ON f.key = c.key AND c.n = f.n + 1)
SELECT id, key, allowed FROM f WHERE n > 0""")
def rate_limit_sliding(spark, d):
    return limits.sliding(calls(spark, d), 86400.0, 2)


@query("SELECT start, event_type, count(*)::BIGINT AS n FROM (SELECT unnest([epoch_us(ts) // 86400000000 * 86400, epoch_us(ts) // 86400000000 * 86400 - 86400])::BIGINT AS start, event_type FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return online.sliding(spark, f"{d}/events.parquet", "2 days", "1 day")


@query("""
WITH log AS (SELECT event_id AS lsn, 'user:' || user_id AS key, CASE event_type WHEN 'signup' THEN 'put' ELSE 'delete' END AS op, props AS value FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 0)),
l AS (SELECT key, arg_max({'op': op, 'value': value}, lsn) AS s, max(lsn) AS last_lsn FROM log GROUP BY key)
SELECT key, s.value AS value, last_lsn FROM l WHERE s.op = 'put'""")
def stream_kv_state(spark, d):
    return online.kv_view(spark, f"{d}/events.parquet")


@query("""
WITH log AS (SELECT event_id AS lsn, 'q' || user_id % 8 AS queue, CASE event_type WHEN 'click' THEN 1 ELSE -1 END AS x FROM events WHERE event_type = 'click' OR (event_type = 'error' AND event_id % 2 = 1)),
w AS (SELECT *, sum(x) OVER (PARTITION BY queue ORDER BY lsn) AS s FROM log), y AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY queue ORDER BY lsn)) AS depth FROM w)
SELECT queue, arg_max(depth, lsn)::BIGINT AS depth, count(*) FILTER (WHERE x = 1)::BIGINT AS enqueued, (count(*) FILTER (WHERE x = 1) - arg_max(depth, lsn))::BIGINT AS taken, max(lsn) AS last_lsn FROM y GROUP BY queue""")
def stream_queue_state(spark, d):
    return online.queue_view(spark, f"{d}/events.parquet")


@query("SELECT (epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return online.tumbling(spark, f"{d}/events.parquet", "1 day")


@query("""
WITH o AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR us - b >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM o)
SELECT user_id, min(us) // 1000000 AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return online.sessions(spark, f"{d}/events.parquet", "6 hours")


@query("""
WITH log AS (SELECT event_id AS lsn, 'user:' || user_id AS key, floor(value)::BIGINT AS amount FROM events WHERE event_type = 'purchase')
SELECT key, sum(amount)::BIGINT AS counter, count(*)::BIGINT AS n, max(lsn) AS last_lsn FROM log GROUP BY key""")
def stream_counter_state(spark, d):
    return online.counter_view(spark, f"{d}/events.parquet")
