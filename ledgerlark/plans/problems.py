"""Queries of the general problems 2 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import asof, changefeed, deliveries, intervals, quantiles
from ledgerlark.session import cut, table

PCTS = (50, 95, 99)
SLOW_MS = {50: 1000, 95: 10_000, 99: 60_000}
LEAST_IDS = 30


def _days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.summarize(quantiles.usage_days(table(spark, d, "usage_events")), ["action", "recorded_day"], "duration_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose percentile exceeds its bound."""
    q = quantiles.percentiles(_days(spark, d), PCTS)
    bound = F.element_at(F.create_map(*(F.lit(x) for kv in SLOW_MS.items() for x in kv)), F.col("pct"))
    return q.filter((F.col("n") >= LEAST_IDS) & (F.col("value") > bound)).select("action", "recorded_day", "pct")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each action and day with the rank error that was tracked."""
    return quantiles.percentiles(_days(spark, d), PCTS)


def p2_over_all_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each action over all days, from the days' own summaries."""
    return quantiles.percentiles(quantiles.merge_summaries(_days(spark, d), ["action"]), PCTS)


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind each summary, which are exact, and whether every rank error keeps the bound."""
    q = quantiles.percentiles(_days(spark, d), PCTS)
    return q.groupBy("action", "recorded_day").agg(F.max("n").alias("n"), F.max((F.col("rank_error") > quantiles.EPS * F.col("n") + 1).cast("int")).alias("beyond_bound"))


def _within(values: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """Whether each percentile lies within its own rank_error of the asked rank, and that within EPS, by exact counts. q has one
    row per group and pct."""
    joined = values.join(q, by)
    counts = joined.groupBy(*by, "pct").agg(F.first("n").alias("n"), F.first("rank_error").alias("e"), F.count("*").alias("rows"), F.count_if(F.col("duration_ms") < F.col("value")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("value")).alias("upto"))
    rank = F.greatest(F.ceil(F.col("pct") * F.col("n") / 100), F.lit(1))
    ok = (F.col("rows") == F.col("n")) & (F.col("below") + 1 - F.col("e") <= rank) & (rank <= F.col("upto") + F.col("e")) & (F.col("e") <= quantiles.EPS * F.col("n") + 1)
    return counts.select(*by, "pct", "n", ok.alias("within"))


def p2_days_checked(spark: SparkSession, d: str) -> DataFrame:
    """p2_percentiles against exact ranks."""
    days = quantiles.usage_days(table(spark, d, "usage_events")).filter("action is not null and recorded_day is not null")
    return _within(days, p2_percentiles(spark, d), ["action", "recorded_day"])


def p2_all_days_checked(spark: SparkSession, d: str) -> DataFrame:
    """p2_over_all_days against exact ranks."""
    days = quantiles.usage_days(table(spark, d, "usage_events")).filter("action is not null")
    return _within(days, p2_over_all_days(spark, d), ["action"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "source_records"), "logical_key", "effective_from", "effective_until")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Periods, gaps and covered and uncovered days of each key (open periods aside)."""
    r = p3_found(spark, d)
    ms = F.when(F.col("until_ms") >= 0, F.col("until_ms") - F.col("from_ms"))
    is_p = F.col("row_kind") == "period"
    return r.groupBy("logical_key").agg(F.count_if(is_p).alias("periods"), F.count_if(~is_p).alias("gaps"), F.coalesce(F.sum(F.when(is_p, ms)), F.lit(0)).alias("covered_ms"), F.coalesce(F.sum(F.when(~is_p, ms)), F.lit(0)).alias("gap_ms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Batch by batch in order of arrival, each against the stored index."""
    return deliveries.repeated_deliveries(table(spark, d, "observations"), "arrival_window")


def p4_byte_reissues(spark: SparkSession, d: str) -> DataFrame:
    """Of the messages in the maintenance workload: deliveries, repeated ones, and how many copies came in other bytes, by
    gold label and the flag byte_only_reissue."""
    obs = table(spark, d, "observations")
    rep = deliveries.repeated_deliveries(obs).withColumn("repeated", F.lit(1))
    message = F.lower(F.trim("observation_id")).alias("message")
    per = obs.join(rep, "delivery_id", "left").select(message, "content_digest", "repeated").filter("message is not null").groupBy("message").agg(F.count("*").alias("deliveries"), F.count("repeated").alias("repeated"), F.countDistinct("content_digest").alias("bodies"))
    work = table(spark, d, "maintenance_workload").select(message, "gold_label", "byte_only_reissue").filter("message is not null")
    return work.join(per, "message").groupBy("gold_label", "byte_only_reissue").agg(F.count("*").alias("rows"), F.sum("deliveries").alias("deliveries"), F.sum("repeated").alias("repeated"), F.sum((F.col("bodies") > 1).cast("int")).alias("in_other_bytes"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return asof.revocations_in_force(table(spark, d, "company_events"), table(spark, d, "revocations"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).filter("revocation_id is not null")


def p5_all_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its revocation or none, by the way that large histories take: sorted (entity, day) groups."""
    return asof.revocations_in_force(table(spark, d, "company_events"), table(spark, d, "revocations"), broadcast_rows=0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    state = changefeed.fold(changefeed.fact_changes(table(spark, d, "company_events"), table(spark, d, "tombstones")))
    return changefeed.standing(state).select(F.col("key").alias("fact_id"), F.col("payload").alias("event_id"))


def p6_tombstones_kept(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are deleted, with the sequence that a later change has to exceed."""
    state = changefeed.fold(changefeed.fact_changes(table(spark, d, "company_events"), table(spark, d, "tombstones")))
    return state.filter(F.col("op") == changefeed.DELETE).select(F.col("key").alias("fact_id"), F.col("seq").cast("bigint").alias("seq"))


def p6_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """The facts of p6_found, from two batches: all withdrawals and the events that arrived in the first half of the time, then
    the later events (and those without a time) on top of the stored state."""
    events, gone = table(spark, d, "company_events"), table(spark, d, "tombstones")
    low, high = events.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    early = F.coalesce(F.col("arrived_at") < F.lit(low + (high - low) / 2), F.lit(False)) if low is not None else F.lit(False)
    first = cut(changefeed.feed_state(events.filter(early), gone))
    state = changefeed.feed_state(events.filter(~early), gone.filter("false"), first)
    return changefeed.facts_after(state).select(F.col("key").alias("fact_id"), F.col("payload").alias("event_id"))


def p6_on_base(spark: SparkSession, d: str) -> DataFrame:
    """The facts of p6_found, with the table as of half of all cursors as base rows and only the changes after it."""
    changes = changefeed.fact_changes(table(spark, d, "company_events"), table(spark, d, "tombstones"))
    top = table(spark, d, "company_events").agg(F.max(changefeed.cursor(F.col("store_cursor"))).alias("c")).first()["c"]
    half = F.lit(int(top or 0) // 2).cast("decimal(38,0)")
    state = changefeed.fold(changes.filter(F.col("seq") > half), cut(changefeed.fold(changes.filter(F.col("seq") <= half))))
    return changefeed.standing(state).select(F.col("key").alias("fact_id"), F.col("payload").alias("event_id"))


QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_over_all_days, p2_group_sizes, p2_days_checked, p2_all_days_checked, p3_found, p3_coverage, p4_found, p4_byte_reissues, p5_found, p5_all_events, p6_found, p6_tombstones_kept, p6_two_batches, p6_on_base)}

_P2 = """with one as (select id, min(struct_pack(r := recorded_at, a := action, m := duration_ms)) e from usage_events
 where id is not null and duration_ms is not null group by id),
 u as (select e.a as action, strftime(e.r at time zone 'UTC', '%Y-%m-%d') as recorded_day, e.m as ms from one)"""
_P3 = """with iv as (select logical_key, epoch_ms(effective_from) s, coalesce(epoch_ms(effective_until), 4503599627370496) e from source_records
 where logical_key is not null and effective_from is not null),
 o as (select *, max(e) over (partition by logical_key order by s, e rows between unbounded preceding and 1 preceding) prior from iv where e > s),
 st as (select *, lead(prior) over (partition by logical_key order by s) nx from o where prior is null or s > prior),
 top as (select logical_key, max(e) m from iv where e > s group by 1),
 r as (select logical_key, 'period' row_kind, s from_ms, case when coalesce(nx, m) >= 4503599627370496 then -1 else coalesce(nx, m) end until_ms from st join top using (logical_key)
  union all select logical_key, 'gap', prior, s from st where prior is not null)"""
_P4 = """with o as (select delivery_id, row_number() over (partition by lower(trim(observation_id)) order by delivered_at nulls last, delivery_id) n, lower(trim(observation_id)) message, content_digest from observations where observation_id is not null)"""
_P5 = """with r as (select *, regexp_replace(lower(trim(revoked_key)), '^[^:]*:\\s*', '') k from revocations),
 e as (select *, regexp_replace(lower(trim(signer)), '^[^:]*:\\s*', '') k from company_events),
 m as (select e.feed_row_id, max(struct_pack(t := r.effective_at, i := r.revocation_id)) b from e join r on e.k = r.k and r.effective_at <= e.recorded_at and r.published_at <= e.recorded_at and (r.revoked_scope is null or r.revoked_scope = e.authority_scope) group by 1)"""
_P6 = """with f as (select event_id, arg_min(case when message_type = 'fact-event' then fact_id end, try_cast(trim(store_cursor) as bigint)) fact_id, min(try_cast(trim(store_cursor) as bigint)) c from company_events group by 1),
 ch as (select fact_id, c, 0 op, event_id from f where fact_id is not null
  union all select g.fact_id, e.c, 1, e.event_id from (select distinct tombstone_id, target_event_id from tombstones where signer_authorized) t join f e on e.event_id = t.tombstone_id join f g on g.event_id = t.target_event_id where g.fact_id is not null),
 w as (select *, row_number() over (partition by fact_id order by c desc, op desc, event_id desc) n from ch)"""

SQL = {
    "p2_found": _P2 + """, r as (select *, row_number() over (partition by action, recorded_day order by ms) k, count(*) over (partition by action, recorded_day) n from u)
 select action, recorded_day, cast(p.pct as integer) as pct from r, (values (50, 1000), (95, 10000), (99, 60000)) p(pct, bound) where n >= 30 and k = (p.pct * n + 99) // 100 and ms > bound""",
    "p2_group_sizes": _P2 + " select action, recorded_day, count(*) as n, cast(0 as integer) as beyond_bound from u group by 1, 2",
    "p2_days_checked": _P2 + " select action, recorded_day, cast(pct as integer) as pct, count(*) as n, true as within from u, (values (50), (95), (99)) p(pct) where action is not null and recorded_day is not null group by 1, 2, 3",
    "p2_all_days_checked": _P2 + " select action, cast(pct as integer) as pct, count(*) as n, true as within from u, (values (50), (95), (99)) p(pct) where action is not null group by 1, 2",
    "p3_found": _P3 + " select * from r",
    "p3_coverage": _P3 + """ select logical_key, count(*) filter (row_kind = 'period') as periods, count(*) filter (row_kind = 'gap') as gaps,
 cast(coalesce(sum(until_ms - from_ms) filter (row_kind = 'period' and until_ms >= 0), 0) as bigint) as covered_ms, cast(coalesce(sum(until_ms - from_ms) filter (row_kind = 'gap'), 0) as bigint) as gap_ms from r group by 1""",
    "p4_found": _P4 + " select delivery_id from o where n > 1",
    "p4_byte_reissues": _P4 + """, per as (select message, count(*) deliveries, count(*) filter (n > 1) repeated, count(distinct content_digest) bodies from o group by 1)
 select gold_label, byte_only_reissue, count(*) as rows, cast(sum(deliveries) as bigint) as deliveries, cast(sum(repeated) as bigint) as repeated, count(*) filter (bodies > 1) as in_other_bytes
 from maintenance_workload w join per on per.message = lower(trim(w.observation_id)) group by 1, 2""",
    "p5_found": _P5 + " select feed_row_id, b.i as revocation_id from m",
    "p5_all_events": _P5 + " select e.feed_row_id, m.b.i as revocation_id from e left join m using (feed_row_id)",
    "p6_found": _P6 + " select fact_id, event_id from w where n = 1 and op = 0",
    "p6_two_batches": _P6 + " select fact_id, event_id from w where n = 1 and op = 0",
    "p6_on_base": _P6 + " select fact_id, event_id from w where n = 1 and op = 0",
    "p6_tombstones_kept": _P6 + " select fact_id, c as seq from w where n = 1 and op = 1",
}
