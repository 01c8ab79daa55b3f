"""Queries of the reducer, bound to source_records, revocations and their like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import lattice as L
from ledgerlark.operators import asof, reduce as R
from ledgerlark.session import table

AS_OF = "2025-01-01 00:00:00"

#: The binding of source_records to admitted events; both engines read these expressions.
BIND = {
    "event_id": "native_id",
    "store_kind": "case when origin = 'import' and provenance = 'transcript' and confidence = 0 then 'personal' when owner_id is null or provenance = 'human_review' then 'company' else 'codebase' end",
    "authority_scope": "case when environment_id is not null then 'environment:' || environment_id when owner_id is null or provenance = 'human_review' then 'architecture:company' else 'repo:' || owner_id end",
    "standing": "case when disposition = 'accepted' and atom_kind = 'decision' then 'ratified' when disposition = 'merged' and atom_kind = 'constraint' then 'enforced' when atom_kind = 'reference' then 'exemplary' when disposition = 'merged' then 'prevalent' when atom_kind = 'question' then 'unruled' else 'present' end",
    "origin_trust": "case when lower(branch) = 'main' then 'merged-default' when branch like 'release/%' then 'approved-pr' when branch is null then null else 'unreviewed-branch' end",
    "authorized": "coalesce(confidence = 9000, false)",
    "reachable": "present",
    "verification": "case when provenance = 'bot' and confidence = 0 then 'unverified' when provenance = 'ai_generated' and origin = 'import' then 'signature-invalid' else 'verified' end",
    "environment_registered": "case when environment_id = 'bench' then false when environment_id is not null then true end",
    "source_identity": "unit_id",
    "path": "unit_id",
    "cursor": "record_id",
}
_KEEP = ["logical_key", "statement", "atom_kind", "disposition", "provenance", "signer", "asserted_at", "effective_from", "effective_until", "parents", "confidence"]


def admitted(spark: SparkSession, d: str) -> DataFrame:
    """One event per native_id, its first copy."""
    s = table(spark, d, "source_records").filter("logical_key is not null and native_id is not null")
    cols = [c for c in s.columns if c != "native_id"]
    s = s.groupBy("native_id").agg(F.min_by(F.struct(*cols), "record_id").alias("r")).select("native_id", "r.*")
    e = s.select(*_KEEP, *(F.expr(x).alias(k) for k, x in BIND.items()))
    squeezed = F.regexp_replace(F.lower(F.coalesce("statement", F.lit(""))), r"[^\p{L}\p{N}]", "")
    e = e.withColumn("statement_id", squeezed).withColumn("signer", asof.plain_key(F.col("signer")))
    e = e.withColumn("fact_id", F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws("\u0000", "store_kind", "authority_scope", "statement_id"), 256), 1, 40)))
    return e.withColumn("supersedes", F.when((F.size("parents") == 1) & F.col("disposition").isin("accepted", "merged"), F.col("parents")).otherwise(F.array().cast("array<string>"))).drop("statement")


def rules(e: DataFrame) -> DataFrame:
    """Accepted human decisions of full confidence rule the first two parts of their unit path."""
    return e.filter("atom_kind = 'decision' and disposition = 'accepted' and provenance = 'human' and confidence = 9000 and path is not null").select(F.substring_index("path", "/", 2).alias("path"), "fact_id", F.col("cursor").alias("rule_index"), L.effective_standing(F.col("standing"), F.col("provenance")).alias("standing"))


def _revocations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "revocations").select(asof.plain_key(F.col("revoked_key")).alias("key"), F.col("revoked_scope").alias("scope"), "effective_at", F.expr("try_cast(revocation_cursor as bigint)").alias("cursor"), "observed")


def _tombstones(e: DataFrame) -> DataFrame:
    """Superseded records of no confidence stand for withdrawals of their own event."""
    kind = F.when(F.col("provenance") == "human", "never_true").when(F.col("provenance") == "transcript", "misextraction").otherwise("support_withdrawn")
    return e.filter("confidence = 3000 and (disposition = 'draft' or disposition = 'merged')").select(kind.alias("kind"), F.col("event_id").alias("target_event_id"), F.lit(True).alias("signer_authorized"), F.concat(F.lit("t_"), "event_id").alias("tombstone_id"))


def view(spark: SparkSession, d: str, store: str = "mixed") -> R.View:
    e = admitted(spark, d)
    return R.View(e, _revocations(spark, d), _tombstones(e), AS_OF, store, rules(e))


def standing_clamp(spark: SparkSession, d: str) -> DataFrame:
    e = admitted(spark, d)
    return e.groupBy("standing", "provenance", L.effective_standing(F.col("standing"), F.col("provenance")).alias("effective")).agg(F.count("*").alias("events"))


def governed_standing(spark: SparkSession, d: str) -> DataFrame:
    e = admitted(spark, d)
    return R.with_standing(e, rules(e)).select("event_id", "own", "governed", "rank")


def authority_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.with_standing(admitted(spark, d)).groupBy("store_kind", "rank").agg(F.count("*").alias("events"))


def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "codebase").reasoned.select("event_id", "logical_key", "reason")


def retirement(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).retired


def event_stages(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).staged.select("logical_key", "event_id", "stage")


def statement_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d).clusters
    return c.select("logical_key", "statement_id", "support", "independent", F.col("rank").cast("int").alias("rank"), F.col("first.event_id").alias("first_event"), F.col("newest.event_id").alias("newest_event"), "withheld", "all_revoked")


def heads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).heads.select("logical_key", "event_id", "fact_id", "rank", "support", "outcome")


def current_facts(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d)
    cur = v.heads.filter("outcome = 'CURRENT'").join(v.outcomes.filter("state = 'current'"), "logical_key", "left_semi")
    return cur.select("logical_key", "fact_id", "event_id", F.when(F.col("withheld"), "withheld").otherwise("trusted").alias("trust"), "support", "independent")


def key_states(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).outcomes


def derived_unknowns(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).unknowns()


def reopened_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Unknowns of keys whose decision fell: withdrawn, expired, misextracted or stale."""
    return view(spark, d).unknowns().filter(F.col("kind").isin("withdrawn", "expired", "misextraction", "stale"))


def view_counts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).counts()


def decay_policy(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(L.DECAY_POLICY, "atom_kind string, rule string")


def explicit_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """Question records that stay open: none of their key was accepted later, and none was shrugged off (rejected)."""
    e = admitted(spark, d)
    q = e.filter("atom_kind = 'question'").select("logical_key", "fact_id", "event_id", "asserted_at")
    closed = e.filter("atom_kind = 'question' and disposition in ('accepted', 'merged')").select("fact_id").distinct()
    shrugged = e.filter("atom_kind = 'question' and disposition = 'rejected'").select("logical_key").distinct()
    return q.join(closed, "fact_id", "left_anti").join(shrugged, "logical_key", "left_anti").select("logical_key", "event_id")


def revocation_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Verified company events whose signer was revoked for their scope at some time: per signer the first one, which gets the
    apology, how many are affected and how many remain beyond it."""
    rv = _revocations(spark, d).select("key", "scope").distinct()
    e = table(spark, d, "company_events").filter("verification = 'verified' and message_type = 'fact-event'").select("event_id", asof.plain_key(F.col("signer")).alias("key"), "authority_scope").distinct()
    keys = rv.filter("scope is null").select("key").withColumn("a", F.lit(True))
    scoped = rv.filter("scope is not null").select("key", F.col("scope").alias("authority_scope")).withColumn("b", F.lit(True))
    hit = e.join(keys, "key", "left").join(scoped, ["key", "authority_scope"], "left").filter("a or b")
    return hit.groupBy(F.col("key").alias("signer")).agg(F.min("event_id").alias("first_event"), F.countDistinct("event_id").alias("affected")).withColumn("residual", F.col("affected") - 1)


QUERIES = {f.__name__: f for f in (standing_clamp, governed_standing, authority_rank, eligibility_reasons, retirement, event_stages, statement_clusters, heads, current_facts, key_states, derived_unknowns, reopened_decisions, view_counts, decay_policy, explicit_unknowns, revocation_cascade)}

_EFF = "case when {s} < {c} then case provenance when 'human' then 'authoritative' when 'human_review' then 'prevalent' when 'transcript' then 'prevalent' else 'present' end else standing end".format(
    s="coalesce(list_position(['authoritative','ratified','enforced','exemplary','prevalent','present','unruled'], standing), 8)",
    c="(case provenance when 'human' then 1 when 'human_review' then 5 when 'transcript' then 5 else 6 end)",
)
_BASE = (
    "with src as (select *, row_number() over (partition by native_id order by record_id) n_ from source_records where logical_key is not null and native_id is not null), a0 as (select "
    + ", ".join(["logical_key", "statement", "atom_kind", "disposition", "provenance", "asserted_at", "effective_from", "effective_until", "coalesce(parents, []) as parents", "confidence"] + [f"{x} as {k}" for k, x in BIND.items()])
    + """, regexp_replace(lower(trim(signer)), '^[^:]*:\\s*', '') as signer, regexp_replace(lower(coalesce(statement, '')), '[^\\p{L}\\p{N}]', '', 'g') as statement_id from src where n_ = 1),
 a as (select *, 'fact_' || substr(sha256(store_kind || chr(0) || authority_scope || chr(0) || statement_id), 1, 40) as fact_id, case when len(parents) = 1 and disposition in ('accepted', 'merged') then parents else [] end as supersedes, """
    + _EFF
    + """ as own from a0),
 ru as (select array_to_string(string_split(path, '/')[1:2], '/') as rpath, fact_id as rfact, cursor as ri, own as rs from a where atom_kind = 'decision' and disposition = 'accepted' and provenance = 'human' and confidence = 9000 and path is not null),
 gov as (select e.event_id, arg_min(rs, ri) as rs from a e join ru on (e.path = rpath or starts_with(e.path, rpath || '/')) and rfact <> e.fact_id group by 1),
 g as (select a.*, case when own in ('prevalent', 'present') and list_position(['authoritative','ratified','enforced','exemplary','prevalent','present','unruled'], rs) < list_position(['authoritative','ratified','enforced','exemplary','prevalent','present','unruled'], own) then 'present' else own end as governed from a left join gov using (event_id)),
 RANKED
 rv as (select *, regexp_replace(lower(trim(revoked_key)), '^[^:]*:\\s*', '') k from revocations where observed),
 rk2 as (select rk.*, (select min(effective_at) from rv where k = rk.signer and (revoked_scope is null or revoked_scope = rk.authority_scope)) as revoked_at from rk),
 re as (select *, revoked_at is not null as revoked_later, case when environment_registered = false then 'ENVIRONMENT_UNREGISTERED' when verification = 'unverified' then 'UNVERIFIED' when verification = 'signature-invalid' then 'SIGNATURE_INVALID' when revoked_at <= asserted_at then 'REVOKED' when STORE then 'WRONG_STORE' when rank = 0 or reachable = false then 'UNTRUSTED_BRANCH' end as reason from rk2),
 tb as (select event_id as target, case when provenance = 'human' then 'never_true' when provenance = 'transcript' then 'misextraction' else 'support_withdrawn' end as tkind from a where confidence = 3000 and disposition in ('draft', 'merged')),
 el as (select * from re where reason is null),
 pa as (select e.*, o.event_id as target, (o.rank <= e.rank and o.authority_scope = e.authority_scope) as owns, o.statement_id as other from (select *, unnest(parents) as p from el where len(parents) >= 2) e join el o on o.logical_key = e.logical_key and o.event_id = e.p),
 su as (select *, unnest(supersedes) as s from el where disposition not in ('retracted', 'withdrawn', 'rejected', 'reverted') or disposition is null),
 rt as (select logical_key, target as event_id, cursor as seq_, 1 as step, 'resolved' as why from pa where owns and len(supersedes) = 0
  union all select logical_key, event_id, cursor, 2, 'unauthorized' from pa where not owns and other <> statement_id
  union all select logical_key, unnest(list_concat(supersedes, parents)), cursor, 3, 'retracted' from el where disposition in ('retracted', 'withdrawn')
  union all select logical_key, event_id, cursor, 4, 'self-retraction' from el where disposition in ('retracted', 'withdrawn')
  union all select e.logical_key, s, e.cursor, 5, 'superseded' from su e join el o on o.logical_key = e.logical_key and o.event_id = e.s where o.rank <= e.rank and o.authority_scope = e.authority_scope
  union all select e.logical_key, s, e.cursor, 5, 'superseded' from su e where not exists (select 1 from el o where o.logical_key = e.logical_key and o.event_id = e.s) and exists (select 1 from a where a.event_id = e.s)
  union all select logical_key, event_id, 4611686018427387904, 6, 'never_true' from el join tb on tb.target = el.event_id where tkind = 'never_true'),
 rd as (select logical_key, event_id, arg_max(why, row(seq_, step)) as why from rt group by 1, 2),
 st as (select el.*, case when rd.why is not null then 'RETIRED' when disposition in ('rejected', 'reverted', 'retracted', 'withdrawn', 'expired', 'never_true', 'superseded') then 'NEGATIVE' when effective_from > timestamptz '2025-01-01 00:00:00+00' then 'NOT_YET_EFFECTIVE'
  when coalesce(effective_until, case when disposition in ('draft', 'proposed', 'open', 'incident', 'experiment', 'workaround') then effective_from + interval 7 day end) <= timestamptz '2025-01-01 00:00:00+00' then 'EXPIRED' else 'LIVE' end as stage from el left join rd using (logical_key, event_id)),
 lv as (select st.* from st where stage = 'LIVE' and not exists (select 1 from tb where target = st.event_id and tkind = 'support_withdrawn')),
 cl as (select logical_key, statement_id, count(*) filter (not revoked_later) as support, count(distinct coalesce(source_identity, store_kind || '|' || signer)) filter (not revoked_later) as independent, max(rank) filter (not revoked_later) as rank,
  arg_min(event_id, cursor) filter (not revoked_later) as first_event, arg_max(event_id, cursor) filter (not revoked_later) as newest_event, max(cursor) filter (not revoked_later) as newest,
  coalesce(bool_or(exists (select 1 from tb where target = lv.event_id and tkind = 'misextraction')) filter (not revoked_later), false) as withheld, bool_and(revoked_later) as all_revoked from lv group by 1, 2),
 h0 as (select cl.*, e.event_id, e.fact_id, e.atom_kind, e.store_kind, e.authority_scope, e.disposition, e.source_identity, cl.rank = max(cl.rank) over (partition by cl.logical_key) as top from cl join el e on e.logical_key = cl.logical_key and e.event_id = cl.first_event where not all_revoked),
 h1 as (select *, store_kind = 'codebase' and not top and disposition in ('approved', 'accepted', 'merged', 'deployed', 'current') as drift from h0),
 h2 as (select logical_key, count(*) filter (top) as tops, bool_and(atom_kind = 'observation') filter (top) as obs, bool_and(atom_kind = 'rationale') filter (top) as ratio, count(distinct coalesce(source_identity, '')) filter (top) = 1 as one_source, bool_or(top and store_kind = 'company' and starts_with(authority_scope, 'architecture:')) and bool_or(coalesce(drift, false)) as ad from h1 group by 1),
 h3 as (select h1.*, h2.* exclude (logical_key), tops > 1 and obs and one_source as decays, row_number() over (partition by h1.logical_key order by top desc, case when top and atom_kind = 'observation' then newest end desc nulls last, fact_id, statement_id) as pl, row_number() over (partition by h1.logical_key order by top desc, fact_id, statement_id) as bf from h1 join h2 using (logical_key)),
 h4 as (select *, tops > 1 and not decays and ratio as adds, tops > 1 and not decays and not ratio as conf, tops = 1 and ad as dr from h3),
 h5 as (select *, case when decays then pl = 1 when adds then bf = 1 else top and not conf and not dr end as chosen from h4),
 h6 as (select *, bool_or(chosen and starts_with(authority_scope, 'environment:') and atom_kind = 'observation') over (partition by logical_key) as runtime from h5),
 hd as (select *, case when chosen then 'CURRENT' when top and decays then 'DECAYED' when top and adds then 'ACCUMULATED' when (top and (conf or dr)) or (dr and drift) then 'CONFLICT' when disposition in ('draft', 'proposed', 'open', 'incident', 'experiment', 'workaround') then 'PROPOSED_NOT_ACCEPTED' when runtime and not starts_with(authority_scope, 'environment:') then 'DEFEATED_BY_RUNTIME' else 'CONTRADICTED' end as outcome from h6),
 ko as (select k.logical_key, case when env then 'environment-registry' when coalesce(conflict, false) then 'conflict' when coalesce(cur, false) then 'current' when coalesce(all_rev, false) or rev then 'revoked' when live > 0 and coalesce(supported, 0) = 0 then 'withdrawn' when coalesce(expd, false) then 'expired' when (rej or coalesce(ret, false)) and not coalesce(neg, false) then 'unverified' else 'withdrawn' end as state
  from (select logical_key, bool_or(coalesce(reason = 'ENVIRONMENT_UNREGISTERED', false)) env, bool_or(coalesce(reason = 'REVOKED', false)) rev, bool_or(reason is not null) rej from re group by 1) k
  left join (select logical_key, bool_or(stage in ('EXPIRED', 'NOT_YET_EFFECTIVE')) expd, bool_or(stage = 'NEGATIVE') neg, bool_or(stage = 'RETIRED') ret, count(*) filter (stage = 'LIVE') live from st group by 1) s using (logical_key)
  left join (select logical_key, bool_or(all_revoked) all_rev, sum(support) supported from cl group by 1) c using (logical_key)
  left join (select logical_key, bool_or(outcome = 'CONFLICT') conflict, bool_or(outcome = 'CURRENT') cur from hd group by 1) h using (logical_key))"""
)


def _rank(standing: str) -> str:
    untrusted = "store_kind = 'codebase' and origin_trust is not null and origin_trust <> 'merged-default' and not (origin_trust = 'approved-pr' and authorized)"
    return f"rk as (select *, cast(case when {untrusted} then 0 when {standing} = 'authoritative' then 12 when {standing} = 'ratified' then 11 when {standing} = 'enforced' then 10 when {standing} = 'exemplary' then 9 when {standing} = 'prevalent' then 8 when {standing} = 'unruled' then 0 when store_kind = 'company' then case when starts_with(authority_scope, 'architecture:') then 6 when starts_with(authority_scope, 'environment:') then 3 else 5 end when store_kind = 'codebase' then case when starts_with(authority_scope, 'environment:') then 3 when coalesce(disposition = 'approved', false) or atom_kind in ('constraint', 'decision') then 4 else 2 end else 1 end as integer) as rank from g),"


_ALL = _BASE.replace("RANKED", _rank("governed")).replace("when STORE", "when false")
SQL = {
    "standing_clamp": _ALL + " select standing, provenance, own as effective, count(*) as events from a group by all",
    "governed_standing": _ALL + " select event_id, own, governed, rank from rk",
    "authority_rank": _BASE.replace("RANKED", _rank("own")).replace("when STORE", "when false") + " select store_kind, rank, count(*) as events from rk group by all",
    "eligibility_reasons": _BASE.replace("RANKED", _rank("governed")).replace("when STORE", "when store_kind <> 'codebase'") + " select event_id, logical_key, reason from re",
    "retirement": _ALL + " select logical_key, event_id, why from rd",
    "event_stages": _ALL + " select logical_key, event_id, stage from st",
    "statement_clusters": _ALL + " select logical_key, statement_id, support, independent, rank, first_event, newest_event, withheld, all_revoked from cl",
    "heads": _ALL + " select logical_key, event_id, fact_id, rank, support, outcome from hd",
    "current_facts": _ALL + " select logical_key, fact_id, event_id, case when withheld then 'withheld' else 'trusted' end as trust, support, independent from hd join ko using (logical_key) where outcome = 'CURRENT' and state = 'current'",
    "key_states": _ALL + " select logical_key, state from ko",
    "derived_unknowns": _ALL + " select logical_key, state as kind, 'unknown_' || substr(sha256('mixed' || chr(0) || logical_key || chr(0) || state || chr(0)), 1, 40) as unknown_id from ko where state <> 'current'",
    "reopened_decisions": _ALL + " select logical_key, state as kind, 'unknown_' || substr(sha256('mixed' || chr(0) || logical_key || chr(0) || state || chr(0)), 1, 40) as unknown_id from ko where state in ('withdrawn', 'expired', 'misextraction', 'stale')",
    "view_counts": _ALL + " select state, count(*) as keys from ko group by 1",
    "decay_policy": "select * from (values ('observation', 'newest-cursor-within-same-source'), ('claim', 'conflict-unless-superseded'), ('decision', 'conflict-unless-superseded'), ('constraint', 'conflict-unless-superseded'), ('rationale', 'accumulate')) t(atom_kind, rule)",
    "explicit_unknowns": _ALL + " select logical_key, event_id from a where atom_kind = 'question' and not exists (select 1 from a b where b.atom_kind = 'question' and b.disposition in ('accepted', 'merged') and b.fact_id = a.fact_id) and not exists (select 1 from a b where b.atom_kind = 'question' and b.disposition = 'rejected' and b.logical_key = a.logical_key)",
    "revocation_cascade": "with e as (select distinct event_id, regexp_replace(lower(trim(signer)), '^[^:]*:\\s*', '') as signer, authority_scope from company_events where verification = 'verified' and message_type = 'fact-event'), r as (select distinct regexp_replace(lower(trim(revoked_key)), '^[^:]*:\\s*', '') k, revoked_scope s from revocations) select signer, min(event_id) as first_event, count(distinct event_id) as affected, count(distinct event_id) - 1 as residual from e join r on k = signer and (s is null or s = authority_scope) group by 1",
}


def projection_selected(spark: SparkSession, d: str) -> DataFrame:
    """The context chosen from all records' facts for TASK and DECISION of the text queries."""
    from ledgerlark.functions import text as X
    from ledgerlark.operators import projection as P
    from ledgerlark.plans import text as Q

    s = table(spark, d, "source_records").filter("statement is not null and logical_key is not null")
    loss = L.pick(F.col("atom_kind"), L.DEFAULT_LOSS, 3000)
    facts = s.select(
        F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws("\u0000", "logical_key", "statement"), 256), 1, 40)).alias("fact_id"), "logical_key", "statement", "atom_kind", F.when(F.col("owner_id").isNull(), "company").otherwise("codebase").alias("store_kind"),
        F.coalesce("environment_id", F.lit("repo")).alias("authority_scope"), loss.alias("loss"), F.coalesce("confidence", F.lit(0)).alias("confidence"), F.lit(1).alias("independent"), F.array("unit_id").alias("support"), F.lit("").alias("trigger"),
    )
    words = F.array_distinct(F.transform(X.terms(F.col("statement")), X.stem))
    query = F.array_distinct(F.transform(X.terms(F.lit(Q.TASK + " " + Q.DECISION)), X.stem))
    rel = facts.select("statement").distinct().select("statement", F.least(F.lit(10_000), 2000 + 1500 * F.size(F.array_intersect(words, query))).alias("bp"))
    return P.select(P.candidates(facts, Q.TASK, Q.DECISION, rel))


QUERIES["projection_selected"] = projection_selected
