"""Sinks: append without repeats, upsert, content-addressed files, quarantine, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(df: DataFrame, fields: list[str], line: str) -> Column:
    """Digest of the key fields; of the whole line where one is missing."""
    whole = F.sha2(F.col(line), 256)
    ok = None
    for f in fields:
        ok = F.col(f).isNotNull() if ok is None else ok & F.col(f).isNotNull()
    return F.when(ok, F.sha2(F.concat_ws("\u0000", *fields), 256)).otherwise(whole)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key isn't stored yet; of copies in the batch the first (least) stands. Returns how many."""
    spark = rows.sparkSession
    cols = [c for c in rows.columns if c != key]
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*")
    if _exists(spark, path):
        one = one.join(spark.read.parquet(path).select(key), key, "left_anti")
    one = one.persist()
    n = one.count()
    if n:
        one.write.mode("append").parquet(path)
    one.unpersist()
    return n


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key of both; base tables of a format with MERGE can take ``changes`` directly."""
    both = base.unionByName(changes, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")


def content_addressed(events: DataFrame, body: str, path: str) -> None:
    """Rows under the first two digits of their digest. What is stored already isn't written again; of the store, digests are read
    only in the prefixes that occur. Null bodies are left out."""
    d = F.sha2(F.col(body), 256)
    new = events.filter(F.col(body).isNotNull()).select(F.substring(d, 1, 2).alias("prefix"), d.alias("digest"), F.col(body).alias("event")).dropDuplicates(["digest"])
    if _exists(events.sparkSession, path):
        new = new.join(events.sparkSession.read.schema("digest string, event string, prefix string").parquet(path).select("prefix", "digest"), ["prefix", "digest"], "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(path)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes a view unless its rows, in any order, are those that the stored receipt names. The digest is the count and a sum of
    row hashes, twice seeded, so it needs no order. Returns whether it wrote."""
    spark, cols = df.sparkSession, sorted(df.columns)
    row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    r = df.agg(F.count("*"), big(F.xxhash64(row)), big(F.xxhash64(F.lit("again"), row))).first()
    receipt = f"{','.join(cols)}:{r[0]}:{r[1]}:{r[2]}"
    at = f"{path}_receipt"
    if _exists(spark, path) and _exists(spark, at) and spark.read.text(at).first()[0] == receipt:
        return False
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(receipt,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return True


def quarantine(records: DataFrame, what: list[str]) -> DataFrame:
    """Rows with a problem, one per what failed, not per when."""
    bad = records.filter("problem is not null")
    return bad.withColumn("quarantine_id", F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*what, "problem"])), 256)).dropDuplicates(["quarantine_id"])


def unexpired(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows within the retention; the filter reaches the scan, expired partitions are rewritten from its result."""
    return df.filter(F.col(at) > F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def oldest_batch(df: DataFrame, at: str, key: str, n: int = 1000) -> DataFrame:
    return df.orderBy(at, key).limit(n).select(key)
