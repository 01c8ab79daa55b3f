"""Attributes as known at event time.

Every attribute keeps a change history of its own, (entity, known_at, value). For each event and each attribute the last
change known at the event's time is looked up separately, and the answers are pivoted back beside the event, so attributes
that change at different times never make wide versions of the whole entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A history is broadcast only if it was counted to have at most this many rows and bytes of keys, and at most STEPS changes of
#: any one entity, so that no event meets more than STEPS rows. All others are matched in (entity, time bucket) groups.
BROADCAST_ROWS, BROADCAST_BYTES, STEPS = 100_000, 16 << 20, 64
BUCKET_SECONDS = 86_400


def last_known(events: DataFrame, history: DataFrame, out: str, bucket_seconds: int = BUCKET_SECONDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``events`` (columns entity, at and others) with ``out``: the value of the latest history row (entity, known_at, value)
    with known_at <= at, or null.

    Rows of history with equal (entity, known_at) must have been reduced to one (``step_history`` does). Events with null
    entity or time keep a null. Histories are matched by sorting: events of one entity are split by time bucket, and the
    version that holds at a bucket's start is carried into it, so a hot entity is spread over its buckets. A history of few
    and short steps (BROADCAST_ROWS, BROADCAST_BYTES, STEPS, counted first) is broadcast as spans [known_at, next) instead.
    """
    if broadcast_rows and _few(history, broadcast_rows):
        spans = history.select(F.col("entity").alias("_e"), F.col("known_at").alias("_k"), F.col("value").alias(out), F.lead("known_at").over(W.partitionBy("entity").orderBy("known_at")).alias("_n"))
        on = (F.col("entity") == F.col("_e")) & (F.col("_k") <= F.col("at")) & (F.col("_n").isNull() | (F.col("at") < F.col("_n")))
        return events.join(F.broadcast(spans), on, "left").drop("_e", "_k", "_n")
    cols = events.columns
    bucket = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    ev = events.withColumn("_b", bucket(F.col("at")))
    hist = history.select("entity", "known_at", "value", bucket(F.col("known_at")).alias("_b"))
    marks = ev.filter("entity is not null and at is not null").select("entity", "_b").distinct()
    # What holds just before each bucket that has events.
    lasts = hist.groupBy("entity", "_b").agg(F.max(F.struct("known_at", "value")).alias("v"))
    line = lasts.select("entity", "_b", "v", F.lit(False).alias("mark")).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    carry = line.withColumn("v", F.last("v", True).over(W.partitionBy("entity").orderBy("_b").rangeBetween(W.unboundedPreceding, -1))).filter("mark and v is not null")
    steps = carry.select("entity", "_b", "v.known_at", "v.value").unionByName(hist.join(marks, ["entity", "_b"], "left_semi").select("entity", "_b", "known_at", "value"))
    both = ev.withColumn("_at", F.col("at")).unionByName(steps.select("entity", "_b", F.col("known_at").alias("_at"), F.struct(F.col("value").alias("value")).alias("_v")), allowMissingColumns=True).withColumn("_event", F.col("_v").isNull().cast("int"))
    w = W.partitionBy("entity", "_b").orderBy("_at", "_event").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_w", F.last("_v", True).over(w)).filter("_event = 1").select(*cols, F.when(F.col("entity").isNotNull() & F.col("at").isNotNull(), F.col("_w.value")).alias(out))


def _few(history: DataFrame, rows: int) -> bool:
    size = history.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.octet_length("entity")).alias("b")).agg(F.sum("n"), F.sum("b"), F.max("n")).first()
    return (size[0] or 0) <= rows and (size[1] or 0) <= BROADCAST_BYTES and (size[2] or 0) <= STEPS


def step_history(changes: DataFrame, known_at: Column, rank: Column) -> DataFrame:
    """History rows (entity, known_at, value): value is the greatest ``rank`` struct among all changes known by then.
    Changes with null entity or known time are ignored; equal times become one step."""
    rows = changes.select("entity", known_at.alias("known_at"), rank.alias("value")).filter("entity is not null and known_at is not null")
    w = W.partitionBy("entity").orderBy("known_at").rowsBetween(W.unboundedPreceding, 0)
    best = rows.groupBy("entity", "known_at").agg(F.max("value").alias("value"))
    return best.withColumn("value", F.max("value").over(w))


def plain_key(c: Column) -> Column:
    """A key without case, blanks around it and an algorithm prefix that ends in a colon."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^[^:]*:\s*", "")


def revocations_in_force(events: DataFrame, revocations: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``feed_row_id`` and the ``revocation_id`` in force and known at recorded_at, null where none is.

    Two attributes of a signer change independently: its revocation for every scope, and that for one scope. Each has its
    own history; a revocation is known from the later of effective_at and published_at. The one latest in effective_at
    counts, on ties the largest revocation_id. Null signers, times and keys match nothing.
    """
    rev = revocations.filter("effective_at is not null and published_at is not null").select(plain_key(F.col("revoked_key")).alias("k"), "revoked_scope", "effective_at", "published_at", "revocation_id")
    known, rank = F.greatest("effective_at", "published_at"), F.struct("effective_at", "revocation_id")
    everywhere = step_history(rev.filter("revoked_scope is null").withColumn("entity", F.col("k")), known, rank)
    scoped = step_history(rev.filter("revoked_scope is not null").withColumn("entity", F.concat_ws("\u0000", "k", "revoked_scope")), known, rank)
    ev = events.select("feed_row_id", plain_key(F.col("signer")).alias("k"), F.col("authority_scope").alias("scope"), F.col("recorded_at").alias("at"))
    ev = last_known(ev.withColumn("entity", F.col("k")), everywhere, "of_all", broadcast_rows=broadcast_rows)
    ev = last_known(ev.withColumn("entity", F.when(F.col("k").isNotNull() & F.col("scope").isNotNull(), F.concat_ws("\u0000", "k", "scope"))), scoped, "of_scope", broadcast_rows=broadcast_rows)
    return ev.select("feed_row_id", F.greatest("of_all", "of_scope")["revocation_id"].alias("revocation_id"))
