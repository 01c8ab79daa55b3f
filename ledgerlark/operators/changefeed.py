"""Applying a change feed of inserts, updates and deletes.

The fold is commutative and idempotent: per key, the maximum of struct(sequence, operation, payload). Rows may come in any
order and any number of times, in one batch or many; the folded state keeps deletions, so a late change older than a
deletion cannot bring its key back.

A feed whose withdrawals name events, not keys, folds in two steps: its state keeps each event's first copy and every
withdrawal, also those whose target hasn't come yet, and the changes of the keys follow from the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of operations at an equal sequence: a deletion wins.
SET, DELETE = 0, 1


def fold(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The newest change of each key: rows (key, seq bigint, op int, payload string), deletions included.

    ``changes`` and ``base`` (an earlier fold) have these columns. Rows with null key or seq are ignored. At an equal
    sequence a deletion wins, then the largest payload. max() is pre-aggregated before the shuffle, so a hot key costs one
    row per task.
    """
    cols = ["key", "seq", "op", "payload"]
    rows = changes.select(*cols)
    if base is not None:
        rows = rows.unionByName(base.select(*cols))
    best = rows.filter("key is not null and seq is not null").groupBy("key").agg(F.max(F.struct("seq", "op", "payload")).alias("m"))
    return best.select("key", "m.*")


def standing(state: DataFrame) -> DataFrame:
    """The keys that stand after all changes."""
    return state.filter(F.col("op") == SET).select("key", "payload")


#: Columns of the stored state of a feed: an event's first copy (kind "event": id, seq, fact_id) or a withdrawal
#: (kind "tombstone": id, target_event_id; it counts from its own event's sequence, wherever and whenever that comes).
STATE = "kind string, id string, seq decimal(38,0), fact_id string, target_event_id string"


def cursor(c: Column) -> Column:
    """The number that a cursor's decimal text means, up to 38 digits; null where it isn't one."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)"))


def feed_state(events: DataFrame, tombstones: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """What a feed has brought so far, one row per event and withdrawal: columns of STATE.

    ``base`` is an earlier state. The fold is a minimum per key, so batches may come in any order, overlap and repeat:
    an event_id counts once, at its lowest numeric store_cursor (spelling ignored; unreadable cursors are ignored), and on
    equal cursors with the least fact_id. A withdrawal is kept although its own event or its target hasn't come yet; both
    are looked for whenever facts are derived. Null ids are ignored. Pre-aggregated before the shuffle.
    """
    firsts = events.select(F.col("event_id").alias("id"), cursor(F.col("store_cursor")).alias("seq"), F.when(F.col("message_type") == "fact-event", F.col("fact_id")).alias("fact_id")).filter("id is not null and seq is not null")
    gone = tombstones.filter("signer_authorized and target_event_id is not null and tombstone_id is not null").select(F.col("tombstone_id").alias("id"), "target_event_id")
    if base is not None:
        firsts = firsts.unionByName(base.filter("kind = 'event'").select("id", "seq", "fact_id"))
        gone = gone.unionByName(base.filter("kind = 'tombstone'").select("id", "target_event_id"))
    firsts = firsts.groupBy("id").agg(F.min(F.struct("seq", "fact_id")).alias("m"))
    # Two branches with a constant kind: a reader of one kind only computes that one, and finds it partitioned by id.
    seen = firsts.select(F.lit("event").alias("kind"), "id", "m.seq", "m.fact_id", F.lit(None).cast("string").alias("target_event_id"))
    kept = gone.distinct().select(F.lit("tombstone").alias("kind"), "id", F.lit(None).cast("decimal(38,0)").alias("seq"), F.lit(None).cast("string").alias("fact_id"), "target_event_id")
    return seen.unionByName(kept)


def changes_of(state: DataFrame) -> DataFrame:
    """The changes of facts that a feed's state means: rows (key=fact_id, seq, op, payload=event_id).

    A fact-event sets its fact. A withdrawal, at its own event's sequence, deletes the fact of its target; where its event or
    its target is unknown (so far), it does nothing.
    """
    events = state.filter("kind = 'event'")
    facts = events.filter("fact_id is not null")
    sets = facts.select(F.col("fact_id").alias("key"), "seq", F.lit(SET).alias("op"), F.col("id").alias("payload"))
    gone = state.filter("kind = 'tombstone'").select("id", "target_event_id").join(events.select("id", "seq"), "id")
    deletes = gone.join(facts.select(F.col("id").alias("target_event_id"), F.col("fact_id").alias("key")), "target_event_id")
    return sets.unionByName(deletes.select("key", "seq", F.lit(DELETE).alias("op"), F.col("id").alias("payload")))


def fact_changes(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The changes of facts of a whole feed (``changes_of`` its ``feed_state``)."""
    return changes_of(feed_state(events, tombstones))


def facts_after(state: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The facts that stand, (key, payload), after the changes of ``state`` on top of the rows of a table, ``base`` (key, seq, op,
    payload): a row of the base stands unless a change has a higher sequence."""
    return standing(fold(changes_of(state), base))
