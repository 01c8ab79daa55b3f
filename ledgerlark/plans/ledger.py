"""Ledger queries: versions, histories, reconciliation, manifests, admission, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import ledger as L
from ledgerlark.plans.text import CANARIES, IDENTIFIERS
from ledgerlark.session import table

SCOPES = ["architecture:company", "architecture:company/payments", "architecture:company/payments/ledger", "architecture:company/search", "repo:lantern", "repo:unknown", "architecture:x/y"]
REGISTRY = [("architecture:payments", "o1"), ("architecture:company", "chief"), ("repo:lantern", "o2"), ("architecture:search", "o3"), ("architecture:search", "o4"), ("architecture:payments/ledger", "o1")]
PAGE = 500


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Fact events, each at its lowest cursor."""
    c = F.expr("try_cast(trim(store_cursor) as bigint)")
    return table(spark, d, "company_events").filter("message_type = 'fact-event' and event_id is not null and fact_id is not null").groupBy("event_id", "fact_id").agg(F.min(c).alias("cursor"))


def fact_versions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("fact_id").orderBy("cursor", "event_id")
    return _events(spark, d).select("fact_id", "event_id", F.row_number().over(w).alias("version"))


def newest_three_versions(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(_events(spark, d), ["fact_id"], [F.col("cursor"), F.col("event_id")], 3).select("fact_id", "event_id")


_HEAD = ["observed_at", "delivered_at", "delivery_id"]


def ordered_head(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each (source_identity, native_id); null instants come first."""
    h = L.latest(_obs(spark, d).filter("native_id is not null"), ["source_identity", "native_id"], [F.col(c) for c in _HEAD])
    return h.select("source_identity", "native_id", "delivery_id", "disposition")


def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Readings that were delivered after their head but observed before it; they're labelled, not dropped."""
    o = _obs(spark, d).filter("native_id is not null").select("source_identity", "native_id", *_HEAD)
    head = o.groupBy("source_identity", "native_id").agg(F.max(F.struct(*_HEAD)).alias("h"))
    return o.join(head, ["source_identity", "native_id"]).filter("observed_at < h.observed_at and delivered_at > h.delivered_at").select("delivery_id", F.col("h.delivery_id").alias("head_delivery"))


def owner_changes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records").filter("logical_key is not null and owner_id is not null")
    at = F.struct("ingested_at", "record_id")
    return s.groupBy("logical_key").agg(F.min_by("owner_id", at).alias("first_owner"), F.max_by("owner_id", at).alias("current_owner")).filter("first_owner != current_owner")


def export_head_and_history(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records").filter("native_id is not null")
    return s.groupBy("native_id").agg(F.max_by("record_id", F.struct(F.coalesce("ingested_at", "asserted_at"), "record_id")).alias("head"), (F.count("*") - 1).alias("history"), F.max_by("present", F.struct(F.coalesce("ingested_at", "asserted_at"), "record_id")).alias("present"))


def symbols_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Native ids whose last readings at different sites have different shapes; one that more than eight sites share is
    keyed per site, so each of its sites has a current row."""
    o = _obs(spark, d).filter("native_id is not null and source_identity is not null")
    last = o.groupBy("native_id", "source_identity").agg(F.max_by("content_digest", F.struct(*_HEAD)).alias("shape"))
    ids = last.groupBy("native_id").agg(F.countDistinct("shape").alias("shapes"), F.count("*").alias("sites"))
    shared = ids.filter("sites <= 8").select("native_id", "sites", F.when(F.col("shapes") > 1, "conflict").otherwise("current").alias("state"))
    per_site = last.join(ids.filter("sites > 8"), "native_id").select("native_id", "sites", F.lit("current").alias("state"))
    return shared.unionByName(per_site)


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of source records after a key, a page being the feature."""
    s = table(spark, d, "source_records").filter("logical_key is not null").select("logical_key", "record_id")
    return L.keyset_page(s, "logical_key", "record_id", ("logical_4", 0), PAGE)


def newest_window_bytes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records").filter("statement is not null").select("record_id", "statement")
    return L.newest_window(s, "record_id", F.octet_length("statement"), 400, 24 * 1024).select("record_id")


def identity_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first copy of each ledger identity; a row without one is its own."""
    i = F.coalesce(F.lower(F.trim("observation_id")), F.concat(F.lit("row:"), F.col("delivery_id")))
    return _obs(spark, d).groupBy(i.alias("identity")).agg(F.min("delivery_id").alias("delivery_id"))


def ledger_compaction(spark: SparkSession, d: str) -> DataFrame:
    """What compaction keeps and drops per kind of source."""
    kept = identity_dedupe(spark, d).select("delivery_id", F.lit(1).alias("kept"))
    return _obs(spark, d).join(kept, "delivery_id", "left").groupBy("source_kind").agg(F.count("kept").alias("kept"), (F.count("*") - F.count("kept")).alias("dropped"))


def manifest_compare(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).filter("repository_id is not null and content_digest is not null")
    return L.compare_sets(o.filter("arrival_window >= 1"), o.filter("arrival_window <= 3"), "repository_id", "content_digest")


def _prior(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).filter("arrival_window <= 2 and native_id is not null and content_digest is not null")
    return o.groupBy("native_id", F.col("content_digest").alias("digest")).agg(F.max_by("lifecycle", "delivery_id").alias("lifecycle"), F.max_by("source_identity", "delivery_id").alias("unit"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).filter("arrival_window >= 3 and native_id is not null and content_digest is not null")
    return o.groupBy("native_id", F.col("content_digest").alias("digest")).agg(F.bool_or(F.col("lifecycle") != "absent").alias("present"))


def reconcile_transitions(spark: SparkSession, d: str) -> DataFrame:
    units = _obs(spark, d).filter("arrival_window >= 3").select(F.col("source_identity").alias("unit")).filter("unit is not null").distinct()
    return L.reconcile(_prior(spark, d), _scan(spark, d).withColumn("present", F.coalesce("present", F.lit(True))), units)


def owner_resolution(spark: SparkSession, d: str) -> DataFrame:
    return L.owners(spark.createDataFrame([(s,) for s in SCOPES], "scope string"), spark.createDataFrame(REGISTRY, "scope string, owner string"))


def parent_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each record's parents with the key of the parent's first copy, null for unknown ones."""
    s = table(spark, d, "source_records")
    keys = s.filter("native_id is not null").groupBy("native_id").agg(F.min_by("logical_key", "record_id").alias("parent_key"))
    return s.select("record_id", F.explode("parents").alias("native_id")).join(keys, "native_id", "left").select("record_id", F.col("native_id").alias("parent"), "parent_key")


def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Supersession references of fact events: the target is missing, of the same fact, or of another."""
    e = table(spark, d, "company_events").filter("message_type = 'fact-event'").select("event_id", "fact_id", "supersedes_event_id").distinct()
    t = e.select(F.col("event_id").alias("supersedes_event_id"), F.col("fact_id").alias("target_fact")).distinct()
    r = e.filter("supersedes_event_id is not null").join(t, "supersedes_event_id", "left")
    state = F.when(F.col("target_fact").isNull(), "missing").when(F.col("target_fact") == F.col("fact_id"), "match").otherwise("mismatch")
    return r.groupBy(state.alias("state")).agg(F.count("*").alias("references"))


def cache_truth_table(spark: SparkSession, d: str) -> DataFrame:
    """Trust of company events by certificate, freshness of revocations and fact, and criticality of the payload."""
    e = table(spark, d, "company_events").filter("message_type = 'fact-event'")
    conf = F.get_json_object("payload", "$.confidence").cast("int")
    trust, why = L.cache_trust(F.col("verification") == "verified", F.dayofmonth("recorded_at") > 7, F.year("recorded_at") >= 2025, F.coalesce(conf >= 7500, F.lit(False)))
    return e.select(trust.alias("trust"), why.alias("reasons")).groupBy("trust", "reasons").agg(F.count("*").alias("events"))


def max_rule(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "maintenance_workload")
    a, b = F.when(F.col("distortion_severity_rank") >= 7, "safety_critical").otherwise("advisory"), F.when(F.col("gold_label") == "durable_shared_fact", "safety").otherwise("advisory")
    c, dom = L.max_rule(a, b)
    return w.groupBy(c.alias("criticality"), dom.alias("dominating")).agg(F.count("*").alias("n"))


def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "source_records").groupBy(L.fact_problem(c("statement"), c("logical_key"), c("disposition"), c("effective_from"), c("effective_until"), c("confidence")).alias("reason")).agg(F.count("*").alias("records"))


def skew_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _obs(spark, d).groupBy("source_kind", L.skew(F.col("observed_at"), F.col("delivered_at"), 86_400).alias("direction")).agg(F.count("*").alias("n"))


def receipts_per_adapter(spark: SparkSession, d: str) -> DataFrame:
    return _obs(spark, d).groupBy("source_kind", "lifecycle").agg(F.count("*").alias("receipts"), F.countDistinct("batch_id").alias("batches"))


def transcript_days(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each batch by the day they belong to; drafts count as undated."""
    o = _obs(spark, d).select("batch_id", "delivery_id", F.when(F.coalesce(F.col("disposition") != "draft", F.lit(True)), F.date_format("observed_at", "yyyy-MM-dd")).alias("day"))
    return L.carried_day(o, "batch_id", "delivery_id", "day").groupBy("batch_id", F.col("day_of").alias("day")).agg(F.count("*").alias("lines"))


def latest_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The last receipt of each candidate, destination and digest, and whether it settles the matter."""
    r = _obs(spark, d).groupBy("native_id", "repository_id", "content_digest").agg(F.max_by("disposition", "delivery_id").alias("last"))
    return r.groupBy("last", F.coalesce(F.col("last").isin("accepted", "rejected"), F.lit(False)).alias("settled")).agg(F.count("*").alias("candidates"))


def bulk_admission(spark: SparkSession, d: str) -> DataFrame:
    """New records that become fact events: with a statement that scans clean, of a key not known from earlier; by provenance."""
    s = table(spark, d, "source_records").filter("logical_key is not null")
    old = s.filter("ingested_at < timestamp '2024-07-01'").select("logical_key").distinct()
    new = s.filter("ingested_at >= timestamp '2024-07-01' and length(trim(statement)) > 0").filter(F.size(X.taints(F.col("statement"), CANARIES, IDENTIFIERS)) == 0)
    return new.join(old, "logical_key", "left_anti").groupBy("provenance").agg(F.count("*").alias("admitted"), F.countDistinct("logical_key").alias("keys"))


def same_statement_status(spark: SparkSession, d: str) -> DataFrame:
    """Statements held by several origins: how many records support each combination."""
    s = table(spark, d, "source_records").filter("statement is not null").select(F.regexp_replace(F.lower("statement"), r"[^\p{L}\p{N}]", "").alias("id"), "origin")
    g = s.groupBy("id").agg(F.countDistinct("origin").alias("origins"), F.count("*").alias("supports"))
    return g.groupBy("origins").agg(F.count("*").alias("statements"), F.sum("supports").alias("supports"))


def touched_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Rows to derive again after the last window came in: all of each touched native id."""
    o = _obs(spark, d).filter("native_id is not null")
    return o.join(o.filter("arrival_window = 4").select("native_id").distinct(), "native_id", "left_semi").groupBy("arrival_window").agg(F.count("*").alias("rows"))


def raised_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question ids and due times of question records, by whether an owner is known."""
    s = table(spark, d, "source_records").filter("atom_kind = 'question' and logical_key is not null and asserted_at is not null")
    return s.select("record_id", X.digest_id("question_", F.col("logical_key"), F.col("native_id"), F.coalesce("statement", F.lit(""))).alias("question_id"), F.when(F.col("owner_id").isNull(), "awaiting_authority").otherwise("open").alias("status"), X.canonical_time(F.col("asserted_at") + F.expr("interval 24 hours")).alias("due_at")).filter("question_id is not null")


def duplicate_statement_keys(spark: SparkSession, d: str) -> DataFrame:
    """Statements that stand under several keys."""
    s = table(spark, d, "source_records").filter("statement is not null and logical_key is not null")
    return s.groupBy(F.sha2("statement", 256).alias("statement_sha")).agg(F.countDistinct("logical_key").alias("keys")).filter("keys > 1")


def latest_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = _obs(spark, d).filter("repository_id is not null")
    return m.groupBy("repository_id", "source_kind").agg(F.max_by("delivery_id", F.struct("delivered_at", "delivery_id")).alias("delivery_id"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_versions, newest_three_versions, ordered_head, late_arrivals, owner_changes, export_head_and_history, symbols_conflict, keyset_page, newest_window_bytes, identity_dedupe, ledger_compaction, manifest_compare, reconcile_transitions, owner_resolution,
        parent_keys, reference_resolution, cache_truth_table, max_rule, quarantine_reasons, skew_quarantine, receipts_per_adapter, transcript_days, latest_receipts, bulk_admission, same_statement_status, touched_cohorts, raised_questions, duplicate_statement_keys, latest_manifest,
    )
}

from ledgerlark.plans.text import _SCAN  # noqa: E402

_E = "with e as (select event_id, fact_id, min(try_cast(trim(store_cursor) as bigint)) as c from company_events where message_type = 'fact-event' and event_id is not null and fact_id is not null group by all)"
_O = "order by observed_at {d} nulls {n}, delivered_at {d} nulls {n}, delivery_id {d}"
_DESC = _O.format(d="desc", n="last")
_VALUES = ", ".join(f"('{s}')" for s in SCOPES), ", ".join(f"('{s}', '{o}')" for s, o in REGISTRY)
SQL = {
    "fact_versions": _E + " select fact_id, event_id, cast(row_number() over (partition by fact_id order by c, event_id) as integer) as version from e",
    "newest_three_versions": _E + " select fact_id, event_id from e qualify row_number() over (partition by fact_id order by c desc, event_id desc) <= 3",
    "ordered_head": f"select source_identity, native_id, delivery_id, disposition from observations where native_id is not null qualify row_number() over (partition by source_identity, native_id {_DESC}) = 1",
    "late_arrivals": f"with h as (select source_identity, native_id, observed_at as ho, delivered_at as hd, delivery_id as head_delivery from observations where native_id is not null qualify row_number() over (partition by source_identity, native_id {_DESC}) = 1) select o.delivery_id, head_delivery from observations o join h using (source_identity, native_id) where observed_at < ho and delivered_at > hd",
    "owner_changes": "select logical_key, arg_min(owner_id, row(ingested_at, record_id)) as first_owner, arg_max(owner_id, row(ingested_at, record_id)) as current_owner from source_records where logical_key is not null and owner_id is not null group by 1 having first_owner <> current_owner",
    "export_head_and_history": "select native_id, arg_max(record_id, row(coalesce(ingested_at, asserted_at), record_id)) as head, count(*) - 1 as history, arg_max(present, row(coalesce(ingested_at, asserted_at), record_id)) as present from source_records where native_id is not null group by 1",
    "symbols_conflict": f"with l as (select native_id, content_digest as shape from observations where native_id is not null and source_identity is not null qualify row_number() over (partition by native_id, source_identity {_DESC}) = 1) select native_id, count(*) as sites, case when count(distinct shape) > 1 then 'conflict' else 'current' end as state from l group by 1 having count(*) <= 8",
    "keyset_page": f"select logical_key, record_id from source_records where logical_key is not null and (logical_key > 'logical_4' or (logical_key = 'logical_4' and record_id > 0)) order by 1, 2 limit {PAGE}",
    "newest_window_bytes": "with t as (select record_id, strlen(statement) as b from source_records where statement is not null order by record_id desc limit 400), s as (select record_id, sum(b) over (order by record_id desc) as s, row_number() over (order by record_id desc) as n from t) select record_id from s where s <= 24576 or n = 1",
    "identity_dedupe": "select coalesce(lower(trim(observation_id)), 'row:' || delivery_id) as identity, min(delivery_id) as delivery_id from observations group by 1",
    "ledger_compaction": "with k as (select min(delivery_id) as delivery_id from observations group by coalesce(lower(trim(observation_id)), 'row:' || delivery_id)) select source_kind, count(k.delivery_id) as kept, count(*) - count(k.delivery_id) as dropped from observations o left join k using (delivery_id) group by 1",
    "manifest_compare": "with m as (select repository_id, content_digest, bool_or(arrival_window >= 1) as l, bool_or(arrival_window <= 3) as p from observations where repository_id is not null and content_digest is not null and arrival_window is not null group by 1, 2), n as (select repository_id, count(*) filter (l and not p) as only_local, count(*) filter (p and not l) as only_published, count(*) filter (l and p) as shared from m group by 1) select repository_id, case when only_local = 0 and only_published = 0 then 'equal' when only_published = 0 then 'superset' when only_local = 0 then 'subset' else 'incomparable' end as relation, only_local, only_published, shared from n",
    "reconcile_transitions": """with o as (select * from observations where native_id is not null and content_digest is not null), p as (select native_id, content_digest as digest, arg_max(lifecycle, delivery_id) as lifecycle, arg_max(source_identity, delivery_id) as unit from o where arrival_window <= 2 group by 1, 2),
 s as (select native_id, content_digest as digest, coalesce(bool_or(lifecycle <> 'absent'), true) as present from o where arrival_window >= 3 group by 1, 2),
 f as (select s.* from s where not exists (select 1 from p where p.native_id = s.native_id and p.digest = s.digest)), fn as (select *, exists (select 1 from p where p.native_id = f.native_id) as amends from f),
 g as (select * from p where lifecycle = 'observed' and not exists (select 1 from s where s.native_id = p.native_id)),
 mv as (select g.native_id, g.digest, n.native_id as to_id from (select *, row_number() over (partition by digest order by native_id) k from g) g join (select *, row_number() over (partition by digest order by native_id) k from fn where not amends) n using (digest, k))
 select p.native_id, p.digest, case when not present and lifecycle = 'observed' then 'absent' when present and lifecycle in ('retracted', 'absent', 'rewritten') then 'observed-again' else 'unchanged' end as change from p join s on s.native_id = p.native_id and s.digest = p.digest
 union all select native_id, digest, 'superseded' from p where lifecycle = 'observed' and exists (select 1 from fn where amends and fn.native_id = p.native_id) and not exists (select 1 from s where s.native_id = p.native_id and s.digest = p.digest)
 union all select native_id, digest, 'renamed' from mv union all select to_id, digest, 'new-name' from mv
 union all select native_id, digest, case when exists (select 1 from observations x where x.arrival_window >= 3 and x.source_identity = g.unit) then 'retracted' else 'absent' end from g where not exists (select 1 from mv where mv.native_id = g.native_id and mv.digest = g.digest)
 union all select native_id, digest, 'amended' from fn where amends
 union all select native_id, digest, 'new' from fn where not amends and not exists (select 1 from mv where mv.to_id = fn.native_id and mv.digest = fn.digest)""",
    "owner_resolution": f"with s(scope) as (values {_VALUES[0]}), r0(scope, owner) as (values {_VALUES[1]}), r as (select scope, min(owner) as owner from r0 group by 1 having count(distinct owner) = 1), u as (select s.scope, min(r.owner) as owner from s join r on starts_with(s.scope, 'architecture:') and contains(s.scope, '/') and ('architecture:' || substr(s.scope, instr(s.scope, '/') + 1) = r.scope or starts_with('architecture:' || substr(s.scope, instr(s.scope, '/') + 1), r.scope || '/')) group by 1 having count(distinct r.owner) = 1) select s.scope, coalesce(r.owner, u.owner) as owner from s left join r using (scope) left join u on u.scope = s.scope",
    "parent_keys": "with k as (select native_id, arg_min(logical_key, record_id) as parent_key from source_records where native_id is not null and logical_key is not null group by 1), p as (select record_id, unnest(parents) as parent from source_records) select record_id, parent, parent_key from p left join k on k.native_id = p.parent",
    "reference_resolution": "with e as (select distinct event_id, fact_id, supersedes_event_id from company_events where message_type = 'fact-event'), t as (select distinct event_id, fact_id as target_fact from e) select case when target_fact is null then 'missing' when target_fact = e.fact_id then 'match' else 'mismatch' end as state, count(*) as references from e left join t on t.event_id = e.supersedes_event_id where supersedes_event_id is not null group by 1",
    "cache_truth_table": "with e as (select verification = 'verified' as c, day(recorded_at at time zone 'UTC') > 7 as r, year(recorded_at at time zone 'UTC') >= 2025 as f, coalesce(try_cast(json_extract_string(payload, '$.confidence') as integer) >= 7500, false) as s from company_events where message_type = 'fact-event') select case when not c then 'withheld' when r and f then 'trusted' when s then 'withheld' else 'excluded' end as trust, case when not c then 'certificate-or-root-invalid' when r and f then '' when r then 'CACHE_EXPIRED' when not f and not s then 'REVOCATION_STALE,CACHE_EXPIRED' else 'REVOCATION_STALE' end as reasons, count(*) as events from e group by 1, 2",
    "max_rule": "with w as (select coalesce(distortion_severity_rank >= 7, false) as a, coalesce(gold_label = 'durable_shared_fact', false) as b from maintenance_workload) select case when a or b then 'safety_critical' else 'advisory' end as criticality, case when a and not b then 'local' when b and not a then 'company' else 'equal' end as dominating, count(*) as n from w group by 1, 2",
    "quarantine_reasons": "select case when logical_key is null or logical_key = '' then 'missing-key' when regexp_matches(logical_key, '[*%?\\x00]') then 'wildcard-key' when statement is null or trim(statement) = '' then 'empty-statement' when strlen(statement) > 16384 then 'statement-too-long' when regexp_matches(statement, '[\\x00-\\x1f\\x{80}-\\x{9f}\\x{061c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]') then 'control-characters' when disposition is null then 'missing-disposition' when effective_from is null then 'missing-start' when effective_until <= effective_from then 'inverted-validity' when not coalesce(confidence between 0 and 10000, false) then 'confidence-out-of-range' end as reason, count(*) as records from source_records group by 1",
    "skew_quarantine": "with x as (select source_kind, trunc((epoch_ms(observed_at) - epoch_ms(delivered_at)) / 1000) as s from observations) select source_kind, case when s > 86400 then 'ahead' when s < -86400 then 'behind' end as direction, count(*) as n from x group by 1, 2",
    "receipts_per_adapter": "select source_kind, lifecycle, count(*) as receipts, count(distinct batch_id) as batches from observations group by 1, 2",
    "transcript_days": "with o as (select batch_id, delivery_id, case when coalesce(disposition <> 'draft', true) then strftime(observed_at at time zone 'UTC', '%Y-%m-%d') end as day from observations), c as (select batch_id, coalesce(last_value(day ignore nulls) over (partition by batch_id order by delivery_id rows between unbounded preceding and current row), first_value(day ignore nulls) over (partition by batch_id order by delivery_id rows between current row and unbounded following)) as day from o) select batch_id, day, count(*) as lines from c group by 1, 2",
    "latest_receipts": "with r as (select native_id, repository_id, content_digest, disposition as last from observations qualify row_number() over (partition by native_id, repository_id, content_digest order by delivery_id desc) = 1) select last, coalesce(last in ('accepted', 'rejected'), false) as settled, count(*) as candidates from r group by 1, 2",
    "bulk_admission": _SCAN + " select provenance, count(*) as admitted, count(distinct logical_key) as keys from source_records s join scan on s.statement = scan.s where logical_key is not null and ingested_at >= timestamptz '2024-07-01 00:00:00+00' and length(trim(statement)) > 0 and taints = '' and not exists (select 1 from source_records o where o.logical_key = s.logical_key and o.ingested_at < timestamptz '2024-07-01 00:00:00+00') group by 1",
    "same_statement_status": "with g as (select regexp_replace(lower(statement), '[^\\p{L}\\p{N}]', '', 'g') as id, count(distinct origin) as origins, count(*) as supports from source_records where statement is not null group by 1) select origins, count(*) as statements, cast(sum(supports) as bigint) as supports from g group by 1",
    "touched_cohorts": "select arrival_window, count(*) as rows from observations where native_id in (select native_id from observations where arrival_window = 4 and native_id is not null) group by 1",
    "raised_questions": "select record_id, 'question_' || substr(sha256(logical_key || chr(0) || coalesce(native_id || chr(0), '') || coalesce(statement, '')), 1, 40) as question_id, case when owner_id is null then 'awaiting_authority' else 'open' end as status, strftime((asserted_at + interval 24 hour) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') as due_at from source_records where atom_kind = 'question' and logical_key is not null and asserted_at is not null",
    "duplicate_statement_keys": "select sha256(statement) as statement_sha, count(distinct logical_key) as keys from source_records where statement is not null and logical_key is not null group by 1 having count(distinct logical_key) > 1",
    "latest_manifest": "select repository_id, source_kind, arg_max(delivery_id, row(delivered_at, delivery_id)) as delivery_id from observations where repository_id is not null group by 1, 2",
}
