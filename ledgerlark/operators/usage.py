"""Usage reports: totals and breakdowns of one snapshot of the request log, over a half-open window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions.text import canonical_time

# Method and route of each action of the service.
ROUTES = {
    "GET /status": "info.status", "GET /facts": "fact.list", "POST /facts": "fact.create", "GET /snapshot": "recall.snapshot", "GET /events": "recall.events",
    "POST /authority-registry": "registry.publish", "GET /authority-registry": "registry.read", "POST /directory": "directory.write", "POST /questions": "question.ask", "GET /questions": "question.list",
    "POST /answers": "answer.write", "GET /answers": "answer.read", "POST /unknowns": "unknown.write", "GET /unknowns": "unknown.list", "POST /certificates": "certificate.issue", "GET /certificates": "certificate.list",
    "POST /manifests": "manifest.publish", "POST /revocations": "revocation.publish", "GET /revocations": "revocation.read", "POST /rotations": "rotation.publish", "POST /tokens": "token.issue", "GET /steward-queue": "steward.queue",
}
PREFIXES = {"/questions/": "question.read", "/directory/": "directory.read", "/certificates/": "certificate.read", "/manifests/": "manifest.read", "/facts/": "fact.read"}
WITHDRAWALS = ["misextraction", "never_true", "support_withdrawn"]


def in_window(df: DataFrame, since: str | None, until: str | None, at: str = "recorded_at") -> DataFrame:
    """[since, until); only bounds that are given become filters, which reach the scan."""
    if since and until and since >= until:
        raise ValueError("since must lie before until")
    if since:
        df = df.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    return df.filter(F.col(at) < F.lit(until).cast("timestamp")) if until else df


def totals() -> list[Column]:
    status = F.col("status")
    ok, bad = F.coalesce(status < 400, F.lit(False)), F.coalesce(status >= 500, F.lit(False))
    return [F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), F.count_if(bad).alias("failed"), F.count_if(~ok & ~bad).alias("refused"), F.countDistinct("principal_id").alias("principals"), F.countDistinct("client").alias("clients"), canonical_time(F.min("recorded_at")).alias("first_at"), canonical_time(F.max("recorded_at")).alias("last_at")]


def by_principal(df: DataFrame) -> DataFrame:
    return df.groupBy("principal_id").agg(*(c for c in totals()[:4]), F.countDistinct("client").alias("clients"), canonical_time(F.max("recorded_at")).alias("last_at"))


def principal_actions(df: DataFrame) -> DataFrame:
    """Counts by principal and action as one sorted map per principal, from pre-aggregated rows: a principal has few actions."""
    n = df.groupBy("principal_id", "action").agg(F.count("*").alias("n"))
    return n.groupBy("principal_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"))


def by_client(df: DataFrame) -> DataFrame:
    return df.groupBy("principal_id", "client", "token_role").agg(F.count("*").alias("requests"), canonical_time(F.max("recorded_at")).alias("last_at"))


def by_action(df: DataFrame) -> DataFrame:
    """With the mean duration, half away from zero."""
    return df.groupBy("action").agg(F.count("*").alias("requests"), F.countDistinct("principal_id").alias("principals"), F.round(F.avg("duration_ms")).cast("bigint").alias("mean_ms"))


def by_period(df: DataFrame, unit: str) -> DataFrame:
    """Tumbling days or hours, named by the prefix of the canonical time."""
    form = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}[unit]
    return df.groupBy(F.date_format("recorded_at", form).alias("period")).agg(F.count("*").alias("requests"), F.countDistinct("principal_id").alias("principals"), F.count_if(F.col("status") >= 400).alias("not_ok"))


def classify(method: Column, route: Column, changes: Column) -> Column:
    """The action of a request; ``changes`` tells whether a posted fact changes an existing one."""
    key = F.concat_ws(" ", method, route)
    out = F.when((key == "POST /facts") & changes, "fact.update")
    for k, v in ROUTES.items():
        out = out.when(key == k, v)
    for p, v in PREFIXES.items():
        out = out.when((method == "GET") & route.startswith(p), v)
    return out.otherwise("unrouted")


def over_budget(df: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Requests that make more than ``limit`` within (t - seconds, t] for their principal. A principal's rows are split by time
    bucket, so one with any share of the rows isn't one task; each row also stands in the next bucket, where it only counts."""
    t = F.unix_micros("recorded_at")
    width = seconds * 1_000_000
    own = F.floor(t / width)
    two = F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    rows = df.filter("recorded_at is not null").withColumn("_t", t).withColumn("_w", two)
    w = W.partitionBy("principal_id", "_w.b").orderBy("_t").rangeBetween(-width + 1, 0)
    return rows.withColumn("in_hour", F.count("*").over(w)).filter("_w.own").filter(F.col("in_hour") > limit).drop("_t", "_w")
