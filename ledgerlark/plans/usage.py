"""Usage queries over usage_events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.text import canonical_time
from ledgerlark.operators import usage as U
from ledgerlark.session import table

SINCE, UNTIL = "2024-01-02 00:00:00", "2024-01-09 00:00:00"


def _u(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage_events")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return _u(spark, d).agg(*U.totals())


def usage_totals_in_window(spark: SparkSession, d: str) -> DataFrame:
    return U.in_window(_u(spark, d), SINCE, UNTIL).agg(*U.totals())


def usage_by_principal(spark: SparkSession, d: str) -> DataFrame:
    return U.by_principal(_u(spark, d))


def principal_action_matrix(spark: SparkSession, d: str) -> DataFrame:
    return U.principal_actions(_u(spark, d)).select("principal_id", F.explode("actions").alias("action", "n"))


def usage_by_client(spark: SparkSession, d: str) -> DataFrame:
    return U.by_client(_u(spark, d))


def usage_by_action(spark: SparkSession, d: str) -> DataFrame:
    return U.by_action(_u(spark, d))


def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return U.by_period(_u(spark, d), "day")


def usage_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return U.by_period(_u(spark, d), "hour")


def usage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Totals, by action, by role, and by both, in one pass."""
    return _u(spark, d).cube("action", "token_role").agg(F.count("*").alias("requests"), F.grouping_id().cast("bigint").alias("level"))


def usage_mark(spark: SparkSession, d: str) -> DataFrame:
    """The mark by which a change of the log is noticed: rows, the largest id, rows without error."""
    return _u(spark, d).agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(F.col("error_code").isNull()).alias("clean"))


def read_volume(spark: SparkSession, d: str) -> DataFrame:
    """Requests and milliseconds per client and hour."""
    return _u(spark, d).groupBy("client", F.date_format("recorded_at", "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count("*").alias("requests"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("ms"))


def refused_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _u(spark, d).filter("error_code is not null").groupBy("error_code").agg(F.count("*").alias("n"))


def over_budget_events(spark: SparkSession, d: str) -> DataFrame:
    return U.over_budget(_u(spark, d).dropDuplicates(["id"]), 40).select("id", "principal_id", "in_hour")


def route_actions(spark: SparkSession, d: str) -> DataFrame:
    """Requests by the action that method and route give, beside the one recorded."""
    u = _u(spark, d)
    method = F.when(F.col("action").rlike(r"\.(create|update|publish|write|ask|issue)$"), "POST").otherwise("GET")
    return u.select("action", U.classify(method, F.col("target"), F.col("action") == "fact.update").alias("classified")).groupBy("action", "classified").agg(F.count("*").alias("n"))


def recent_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 requests, a top-k report."""
    return _u(spark, d).select("id", "recorded_at", "action").distinct().orderBy(F.desc("recorded_at"), F.desc("id")).limit(100).withColumn("recorded_at", canonical_time(F.col("recorded_at")))


QUERIES = {f.__name__: f for f in (usage_totals, usage_totals_in_window, usage_by_principal, principal_action_matrix, usage_by_client, usage_by_action, usage_by_day, usage_by_hour, usage_grouping_sets, usage_mark, read_volume, refused_by_reason, over_budget_events, route_actions, recent_log)}

_T = "count(*) as requests, count(*) filter (status < 400) as succeeded, count(*) filter (status >= 500) as failed, count(*) filter (status is null or status between 400 and 499) as refused"


def _ms(x: str) -> str:
    return f"strftime({x} at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')"


_TOTALS = f"select {_T}, count(distinct principal_id) as principals, count(distinct client) as clients, {_ms("min(recorded_at)")} as first_at, {_ms("max(recorded_at)")} as last_at from usage_events"
_PERIOD = "select strftime(recorded_at at time zone 'UTC', '{f}') as period, count(*) as requests, count(distinct principal_id) as principals, count(*) filter (status >= 400) as not_ok from usage_events group by 1"
_METHOD = "case when regexp_matches(action, '\\.(create|update|publish|write|ask|issue)$') then 'POST' else 'GET' end"
SQL = {
    "usage_totals": _TOTALS,
    "usage_totals_in_window": _TOTALS + f" where recorded_at >= timestamptz '{SINCE}+00' and recorded_at < timestamptz '{UNTIL}+00'",
    "usage_by_principal": f"select principal_id, {_T}, count(distinct client) as clients, {_ms("max(recorded_at)")} as last_at from usage_events group by 1",
    "principal_action_matrix": "select principal_id, action, count(*) as n from usage_events group by 1, 2",
    "usage_by_client": f"select principal_id, client, token_role, count(*) as requests, {_ms("max(recorded_at)")} as last_at from usage_events group by all",
    "usage_by_action": "select action, count(*) as requests, count(distinct principal_id) as principals, cast(round(avg(duration_ms)) as bigint) as mean_ms from usage_events group by 1",
    "usage_by_day": _PERIOD.format(f="%Y-%m-%d"),
    "usage_by_hour": _PERIOD.format(f="%Y-%m-%dT%H"),
    "usage_grouping_sets": "select action, token_role, count(*) as requests, cast(grouping(action, token_role) as bigint) as level from usage_events group by cube (action, token_role)",
    "usage_mark": "select count(*) as n, coalesce(max(id), 0) as top, count(*) filter (error_code is null) as clean from usage_events",
    "read_volume": "select client, strftime(recorded_at at time zone 'UTC', '%Y-%m-%dT%H') as hour, count(*) as requests, cast(coalesce(sum(duration_ms), 0) as bigint) as ms from usage_events group by 1, 2",
    "refused_by_reason": "select error_code, count(*) as n from usage_events where error_code is not null group by 1",
    "over_budget_events": "with u as (select distinct id, principal_id, epoch_us(recorded_at) t from usage_events), w as (select id, principal_id, count(*) over (partition by principal_id order by t range between 3599999999 preceding and current row) as in_hour from u) select * from w where in_hour > 40",
    "route_actions": f"with m as (select action, target, {_METHOD} || ' ' || target as k from usage_events) select action, case when k = 'POST /facts' and action = 'fact.update' then 'fact.update' " + " ".join(f"when k = '{k}' then '{v}'" for k, v in U.ROUTES.items()) + " " + " ".join(f"when starts_with(k, 'GET {p}') then '{v}'" for p, v in U.PREFIXES.items()) + " else 'unrouted' end as classified, count(*) as n from m group by 1, 2",
    "recent_log": f"with r as (select distinct id, recorded_at, action from usage_events order by recorded_at desc, id desc limit 100) select id, {_ms('recorded_at')} as recorded_at, action from r",
}
