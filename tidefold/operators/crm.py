"""Customer records, tags, segments, usage, notes, and the admin views. Indexes are queries, not tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLANS = ("pro", "team", "enterprise")


def customers_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    plan = F.element_at(F.array(*map(F.lit, (*PLANS, "trial"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("customer_id"), F.lower(F.concat("c_name", F.lit("@example.com"))).alias("email"), plan.alias("plan"),
        F.lower("c_mktsegment").alias("segment"), F.array(F.lower("n_name"), F.when(F.col("c_acctbal") < 0, "debtor").otherwise("creditor")).alias("tags"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("sub_"), F.col("c_custkey").cast("string"))).otherwise("").alias("subscription_id"),
        F.col("c_custkey").alias("updated_at"),
    )


def registry_from(orders: DataFrame) -> DataFrame:
    """customer_id, email, plan, api_keys: one key per order, revoked where the order isn't open."""
    key = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("created_at"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_orderkey") + 1).alias("revoked_at"), F.lit("secret").alias("raw_key"))
    rows = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.sort_array(F.collect_list(key)).alias("api_keys"), F.max("o_orderkey").alias("updated_at"))
    return rows.select("customer_id", F.concat(F.lit("Owner"), F.col("customer_id").cast("string"), F.lit("@Example.com")).alias("email"), F.element_at(F.array(*map(F.lit, PLANS)), (F.col("customer_id") % 3 + 1).cast("int")).alias("plan"), "api_keys", "updated_at")


def current_customers(log: DataFrame) -> DataFrame:
    """customer_id, plan, status, created, updated, versions: customers after creates and updates (lsn, customer_id, plan,
    status), each of which replaces the whole record."""
    last = log.groupBy("customer_id").agg(F.max_by(F.struct("plan", "status"), "lsn").alias("s"), F.min("lsn").alias("created"), F.max("lsn").alias("updated"), F.count(F.lit(1)).alias("versions"))
    return last.select("customer_id", "s.plan", "s.status", "created", "updated", "versions")


def list_all(log: DataFrame, customers: DataFrame, limit: int) -> DataFrame:
    """customer_id, created: the first `limit` customers in order of creation, without those that `customers` lacks."""
    index = log.groupBy("customer_id").agg(F.min("lsn").alias("created"))
    return index.join(customers.select("customer_id"), "customer_id", "left_semi").orderBy("created").limit(limit)


def access_codes(log: DataFrame) -> DataFrame:
    """lsn, customer_id, ok: what each check of an access code answers. `log`: (lsn, customer_id, ts, op set/verify,
    code, expires_at). A code is good once, and until it has expired, which it has after its time, not at it; codes are
    compared by their hashes, and a new code replaces the old one."""
    order = Window.partitionBy("customer_id").orderBy("lsn")
    given = F.when(F.col("op") == "set", F.struct(F.col("lsn").alias("at"), F.sha2(F.col("code").cast("binary"), 256).alias("hash"), "expires_at"))
    rows = log.withColumn("code_set", F.last(given, ignorenulls=True).over(order)).where("op = 'verify'")
    fits = (F.col("code_set.hash") == F.sha2(F.col("code").cast("binary"), 256)) & (F.col("ts") <= F.col("code_set.expires_at"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    used = Window.partitionBy("customer_id", "code_set.at").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.max("fits").over(used), F.lit(False))).select("lsn", "customer_id", (F.col("fits") & ~F.col("spent")).alias("ok"))


def artifact_issues(issues: DataFrame) -> DataFrame:
    """customer_id, artifact, n, first, last of issues (lsn, customer_id, artifact)."""
    return issues.groupBy("customer_id", "artifact").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first"), F.max("lsn").alias("last"))


def by_email(customers: DataFrame, email: str) -> DataFrame:
    """The customer that last claimed an e-mail address, letters' case apart."""
    owner = customers.where(F.lower("email") == email.lower()).agg(F.max_by("customer_id", "updated_at").alias("customer_id"))
    return customers.join(owner, "customer_id", "left_semi")


def tag_index(customers: DataFrame) -> DataFrame:
    """tag, n, customers."""
    tags = customers.select("customer_id", F.explode("tags").alias("tag")).select("customer_id", F.lower("tag").alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("customer_id")).alias("customers"))


def with_tag(customers: DataFrame, tag: str) -> DataFrame:
    return customers.where(F.array_contains("tags", tag.lower()))


def segments(customers: DataFrame) -> DataFrame:
    """segment, n, first, last."""
    return customers.groupBy(F.lower("segment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min("customer_id").alias("first"), F.max("customer_id").alias("last"))


def tags_after(changes: DataFrame) -> DataFrame:
    """customer_id, tags: after rows (lsn, customer_id, op add/remove, tag), letters' case apart."""
    last = changes.groupBy("customer_id", F.lower("tag").alias("tag")).agg(F.max_by("op", "lsn").alias("op"))
    return last.where("op = 'add'").groupBy("customer_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def soft_delete(customers: DataFrame, ids: Column) -> DataFrame:
    """Customers where `ids` holds get the tag deleted; they stay listed."""
    return customers.withColumn("tags", F.when(ids & ~F.array_contains("tags", "deleted"), F.array_append("tags", "deleted")).otherwise(F.col("tags")))


def lifetime_value(syncs: DataFrame) -> DataFrame:
    """customer_id, ltv, status: value adds up over active synchronisations; the rest is the last one's."""
    return syncs.groupBy("customer_id").agg(F.round(F.sum(F.when(F.col("status") == "active", F.col("mrr")).otherwise(0.0)), 2).alias("ltv"), F.max_by("status", "lsn").alias("status"))


def usage(counts: DataFrame) -> DataFrame:
    """customer_id, api_calls, compressed_bytes of rows (customer_id, metric, amount), 0 where there are none."""
    pivoted = counts.groupBy("customer_id").pivot("metric", ["api_calls", "compressed_bytes"]).agg(F.sum("amount"))
    return pivoted.na.fill(0)


def notes(customers: DataFrame, log: DataFrame) -> DataFrame:
    """customer_id, support_notes: notes (lsn, customer_id, note_id, op add/resolve, text) in order, each with its status."""
    per = log.groupBy("customer_id", "note_id").agg(F.min("lsn").alias("lsn"), F.max_by("text", F.when(F.col("op") == "add", F.col("lsn"))).alias("text"), F.max((F.col("op") == "resolve").cast("int")).alias("resolved"))
    listed = per.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("lsn", "note_id", "text", "resolved"))).alias("support_notes"))
    return customers.join(listed, "customer_id", "left").select("customer_id", F.coalesce(F.size("support_notes"), F.lit(0)).alias("n_notes"), F.coalesce(F.size(F.filter("support_notes", lambda x: x["resolved"] == 0)), F.lit(0)).alias("n_open"))


def admin_summary(registry: DataFrame, customers: DataFrame) -> DataFrame:
    """One row of totals; revoked keys count."""
    plan = lambda p: F.count_if(F.col("plan") == p).alias(f"plan_{p}")
    r = registry.agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum(F.size("api_keys")), F.lit(0)).cast("long").alias("api_keys"))
    c = customers.agg(F.count(F.lit(1)).alias("db_customers"), F.count_if(F.coalesce(F.col("subscription_id"), F.lit("")) != "").alias("active"), *[plan(p) for p in PLANS], F.count_if(~F.col("plan").isin(*PLANS)).alias("plan_other"))
    return c.select("*", *[r.select(x).scalar().alias(x) for x in ("customers", "api_keys")])


def plan_breakdown(customers: DataFrame) -> DataFrame:
    """plan, n: known plans, zero-filled, and other."""
    spark = customers.sparkSession
    named = F.when(F.col("plan").isin(*PLANS), F.col("plan")).otherwise("other")
    n = customers.groupBy(named.alias("plan")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(p,) for p in (*PLANS, "other")], "plan string").join(n, "plan", "left").select("plan", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merged(registry: DataFrame, customers: DataFrame) -> DataFrame:
    """Registry rows, and customers whose e-mail (letters' case apart) the registry lacks."""
    r = registry.select("customer_id", F.lower("email").alias("email"), "plan", "updated_at", F.lit("registry").alias("origin"))
    c = customers.select("customer_id", F.lower("email").alias("email"), "plan", "updated_at", F.lit("db").alias("origin"))
    return r.unionByName(c.join(r.select("email"), "email", "left_anti"))


def api_keys(registry: DataFrame) -> DataFrame:
    """One row per key with its owner, without the secret."""
    return registry.select("customer_id", "email", "plan", F.explode("api_keys").alias("k")).select("customer_id", "email", "plan", F.col("k.id").alias("key_id"), F.col("k.created_at").alias("created_at"), F.col("k.revoked_at").alias("revoked_at"))


def active_keys(registry: DataFrame, most: int) -> DataFrame:
    """customer_id, active, can_create: keys not revoked, and whether another fits the cap."""
    n = F.size(F.filter("api_keys", lambda k: k["revoked_at"] == 0))
    return registry.select("customer_id", n.alias("active"), (n < most).alias("can_create"))


def entitlements(plans: DataFrame) -> DataFrame:
    """plan, tier, max_keys of price ids (price_id). Unknown prices are plan pro, with one key."""
    plan = F.when(F.col("price_id").contains("enterprise"), "enterprise").when(F.col("price_id").contains("team"), "team").otherwise("pro")
    return plans.select("price_id", plan.alias("plan"), F.when(plan == "enterprise", 10).when(plan == "team", 5).otherwise(1).alias("max_keys"))


def leads(captures: DataFrame) -> DataFrame:
    """email, lsn, n: first capture of each address, letters' case apart."""
    return captures.groupBy(F.lower("email").alias("email")).agg(F.min("lsn").alias("lsn"), F.count(F.lit(1)).alias("n"))
