"""Ledger operations: reconcile a scan with what is known, versions, windows of rows, manifests, owners, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key by ``order`` (ascending columns, nulls first)."""
    w = W.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def reconcile(prior: DataFrame, scan: DataFrame, units: DataFrame, available: bool = True) -> DataFrame:
    """Transitions between a prior ledger and a fresh scan, rows (native_id, digest, change).

    ``prior``: native_id, digest, unit, lifecycle; ``scan``: native_id, digest, present; ``units``: unit of the scan. A known
    reading is unchanged, or absent or observed again as its presence says; of a changed one the old row is superseded; an old
    observed row whose native_id vanished is renamed if a new one carries its digest (each old and new row once), retracted if
    its unit is still there, else absent. Nulls in native_id or digest never match; each side holds a row once.
    """
    p = prior.dropDuplicates(["native_id", "digest"])
    s = scan.dropDuplicates(["native_id", "digest"])
    known = p.join(s, ["native_id", "digest"])
    back = F.col("lifecycle").isin("retracted", "absent", "rewritten")
    same = known.select("native_id", "digest", F.when(~F.col("present") & (F.col("lifecycle") == "observed"), "absent").when(F.col("present") & back, "observed-again").otherwise("unchanged").alias("change"))
    fresh = s.join(p.select("native_id", "digest"), ["native_id", "digest"], "left_anti")
    natives, present = p.select("native_id").distinct(), s.select("native_id").distinct()
    amended = fresh.join(natives, "native_id", "left_semi")
    new = fresh.join(natives, "native_id", "left_anti")
    stale = p.filter("lifecycle = 'observed'")
    superseded = stale.join(amended.select("native_id").distinct(), "native_id", "left_semi").join(s.select("native_id", "digest"), ["native_id", "digest"], "left_anti").select("native_id", "digest", F.lit("superseded").alias("change"))
    gone = stale.join(present, "native_id", "left_anti")
    w = W.partitionBy("digest").orderBy("native_id")
    a, b = gone.select("native_id", "digest", F.row_number().over(w).alias("k")), new.select(F.col("native_id").alias("to_id"), "digest", F.row_number().over(w).alias("k"))
    moved = a.join(b, ["digest", "k"])
    renamed = moved.select("native_id", "digest", F.lit("renamed").alias("change"))
    lost = gone.join(moved.select("native_id", "digest"), ["native_id", "digest"], "left_anti").join(units.select(F.col("unit"), F.lit(True).alias("there")).distinct(), "unit", "left")
    lost = lost.select("native_id", "digest", F.when(F.lit(available) & F.coalesce("there", F.lit(False)), "retracted").otherwise("absent").alias("change"))
    added = amended.select("native_id", "digest", F.lit("amended").alias("change")).unionByName(new.join(moved.select(F.col("to_id").alias("native_id"), "digest"), ["native_id", "digest"], "left_anti").select("native_id", "digest", F.lit("new").alias("change"))).unionByName(moved.select(F.col("to_id").alias("native_id"), "digest", F.lit("new-name").alias("change")))
    return same.unionByName(superseded).unionByName(renamed).unionByName(lost).unionByName(added)


def compare_sets(local: DataFrame, published: DataFrame, by: str, member: str) -> DataFrame:
    """Per group: equal, superset, subset or incomparable; from one full join of distinct members, no set is collected."""
    x = local.select(by, member).distinct().withColumn("l", F.lit(1)).join(published.select(by, member).distinct().withColumn("p", F.lit(1)), [by, member], "full")
    n = x.groupBy(by).agg(F.count_if(F.col("p").isNull()).alias("only_local"), F.count_if(F.col("l").isNull()).alias("only_published"), F.count_if(F.col("l").isNotNull() & F.col("p").isNotNull()).alias("shared"))
    rel = F.when((F.col("only_local") == 0) & (F.col("only_published") == 0), "equal").when(F.col("only_published") == 0, "superset").when(F.col("only_local") == 0, "subset").otherwise("incomparable")
    return n.select(by, rel.alias("relation"), "only_local", "only_published", "shared")


def owners(scopes: DataFrame, registry: DataFrame, fallback: str | None = None) -> DataFrame:
    """(scope, owner): exact, else the fallback scope's, else for architecture scopes the only owner among their ancestors.
    ``registry``: scope, owner. A scope with several registered owners has none."""
    reg = registry.filter("scope is not null and owner is not null").groupBy("scope").agg(F.min("owner").alias("owner"), F.countDistinct("owner").alias("n")).filter("n = 1").select("scope", "owner")
    s = scopes.select("scope").distinct()
    exact = s.join(reg, "scope", "left").withColumnRenamed("owner", "exact")
    if fallback is not None:
        exact = exact.join(F.broadcast(reg.filter(F.col("scope") == fallback).select(F.col("owner").alias("fb"))), F.lit(True), "left")  # one row at most
    else:
        exact = exact.withColumn("fb", F.lit(None).cast("string"))
    parts = F.split("scope", "/")
    chain = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("architecture:"), F.array_join(F.slice(parts, 2, i - 1), "/")))
    up = s.filter("scope like 'architecture:%/%'").select("scope", F.explode(chain).alias("at")).join(reg.select(F.col("scope").alias("at"), "owner"), "at").groupBy("scope").agg(F.min("owner").alias("up"), F.countDistinct("owner").alias("k")).filter("k = 1")
    return exact.join(up.select("scope", "up"), "scope", "left").select("scope", F.coalesce("exact", "fb", "up").alias("owner"))


def carried_day(df: DataFrame, by: str, line: str, day: str) -> DataFrame:
    """The day each line belongs to: its own, else that of the nearest dated line before it, else the first dated one after."""
    back, ahead = W.partitionBy(by).orderBy(line).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(by).orderBy(line).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn("day_of", F.coalesce(F.last(day, True).over(back), F.first(day, True).over(ahead)))


def keyset_page(df: DataFrame, key: str, tie: str, after: tuple | None, size: int) -> DataFrame:
    """The page after (key, tie). The tie column keeps rows of equal keys together across pages."""
    if after is not None:
        df = df.filter((F.col(key) > after[0]) | ((F.col(key) == after[0]) & (F.col(tie) > after[1])))
    return df.orderBy(key, tie).limit(size)


def newest_window(df: DataFrame, order: str, size: Column, items: int, limit: int) -> DataFrame:
    """The newest rows up to ``items`` and ``limit`` bytes; the first row is always kept. Only the top rows are ranked."""
    top = df.withColumn("_b", size).orderBy(F.desc(order)).limit(items)
    w = W.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return top.withColumn("_sum", F.sum("_b").over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_sum") <= limit) | (F.col("_n") == 1)).drop("_b", "_n")


def merkle_root(leaves: DataFrame, digest: str, position: str) -> str:
    """Root of leaf digests (hex) in order of ``position``, pairwise, the odd one doubled; of nothing, the digest of nothing.
    One grouped pass per level, until few rows are left."""
    import hashlib

    spark = leaves.sparkSession
    # A global position needs each partition's count only, which zipWithIndex takes; a window would sort in one task.
    numbered = leaves.select(F.col(digest).alias("h"), F.col(position).alias("p")).orderBy("p", "h").rdd.zipWithIndex().map(lambda x: (x[0]["h"], x[1]))
    level = spark.createDataFrame(numbered, "h string, i bigint")
    n = level.count()
    if n == 0:
        return hashlib.sha256(b"").hexdigest()
    while n > 100_000:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", F.col("i")).alias("a"), F.max_by("h", F.col("i")).alias("b"))
        level = pair.select(F.sha2(F.concat(F.unhex("a"), F.unhex("b")), 256).alias("h"), "i")
        n = -(-n // 2)
    hs = [bytes.fromhex(r["h"]) for r in level.orderBy("i").collect()]
    while len(hs) > 1:
        hs = [hashlib.sha256(hs[k] + (hs[k + 1] if k + 1 < len(hs) else hs[k])).digest() for k in range(0, len(hs), 2)]
    return hs[0].hex()


# Trust of a cached fact by freshness and criticality.
CACHE_TABLE = [
    (True, True, True, "trusted", ""), (True, True, False, "trusted", ""), (True, False, True, "withheld", "CACHE_EXPIRED"), (True, False, False, "excluded", "CACHE_EXPIRED"),
    (False, True, True, "withheld", "REVOCATION_STALE"), (False, False, True, "withheld", "REVOCATION_STALE"), (False, True, False, "excluded", "REVOCATION_STALE"), (False, False, False, "excluded", "REVOCATION_STALE,CACHE_EXPIRED"),
]


def cache_trust(certificate: Column, revocation_fresh: Column, fact_fresh: Column, safety: Column) -> tuple[Column, Column]:
    """(trust, reasons) of a cached fact."""
    trust, why = F.when(~certificate, "withheld"), F.when(~certificate, "certificate-or-root-invalid")
    for r, f, s, t, y in CACHE_TABLE:
        on = (revocation_fresh == r) & (fact_fresh == f) & (safety == s)
        trust, why = trust.when(on, t), why.when(on, y)
    return trust, why


def max_rule(local: Column, company: Column) -> tuple[Column, Column]:
    """(criticality, dominating): safety if either side is; which side dominates."""
    a, b = F.coalesce(local.isin("safety", "safety_critical"), F.lit(False)), F.coalesce(company.isin("safety", "safety_critical"), F.lit(False))
    return F.when(a | b, "safety_critical").otherwise("advisory"), F.when(a & ~b, "local").when(b & ~a, "company").otherwise("equal")


def fact_problem(statement: Column, key: Column, disposition: Column, start: Column, until: Column, confidence: Column) -> Column:
    """The first failing test of a fact event, or null."""
    return (
        F.when(key.isNull() | (key == ""), "missing-key").when(key.rlike(r"[*%?\x00]"), "wildcard-key").when(statement.isNull() | (F.trim(statement) == ""), "empty-statement")
        .when(F.octet_length(statement) > 16 * 1024, "statement-too-long").when(statement.rlike(r"[\x00-\x1f\x80-\x9f\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"), "control-characters")
        .when(disposition.isNull(), "missing-disposition").when(start.isNull(), "missing-start").when(until <= start, "inverted-validity").when(~F.coalesce(confidence.between(0, 10_000), F.lit(False)), "confidence-out-of-range")
    )


def skew(claimed: Column, clock: Column, seconds: int = 300) -> Column:
    """ahead, behind, or null within the tolerance; whole seconds, truncated towards zero."""
    d = (F.unix_millis(claimed) - F.unix_millis(clock)) / 1000
    d = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    return F.when(d > seconds, "ahead").when(d < -seconds, "behind")
