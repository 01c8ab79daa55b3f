"""Queries of relations: dependants, citations, prefixes, votes, signers, derived states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import text as X
from ledgerlark.operators import asof
from ledgerlark.operators import relations as R
from ledgerlark.session import table

AS_OF = "2024-09-01 00:00:00"


def _first(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records").filter("native_id is not null")
    return s.groupBy("native_id").agg(F.min_by(F.struct("record_id", "logical_key", "parents", "asserted_at", "unit_id", "owner_id"), "record_id").alias("r")).select("native_id", "r.*")


def last_dependants(spark: SparkSession, d: str) -> DataFrame:
    s = _first(spark, d)
    return R.last_dependant(s.select(F.col("native_id").alias("fact_id")), s.select(F.col("native_id").alias("event_id"), "parents", "asserted_at", F.col("record_id").alias("position")))


def first_relaxations(spark: SparkSession, d: str) -> DataFrame:
    """Records with the first record of their key that was still valid at AS_OF, by confidence."""
    s = table(spark, d, "source_records").filter("logical_key is not null")
    valid = (F.col("effective_from") <= F.lit(AS_OF).cast("timestamp")) & (F.col("effective_until").isNull() | (F.col("effective_until") > F.lit(AS_OF).cast("timestamp")))
    right = s.select("logical_key", "effective_from", "effective_until", F.col("record_id").alias("relaxed_by"))
    return R.first_match(s.select("logical_key").distinct(), right, ["logical_key"], valid, ["relaxed_by"], "relaxed_by")


def prefix_owners(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records")
    owned = s.filter("owner_id is not null and confidence = 9000").select(F.substring_index("unit_id", "/", 2).alias("prefix"), F.col("owner_id").alias("owner"))
    return R.prefix_owner(s.select(F.col("unit_id").alias("path")), owned)


def first_citations(spark: SparkSession, d: str) -> DataFrame:
    return R.first_citations(table(spark, d, "source_records"), "record_id", "parents")


def rater_votes(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "subject_labels").select("doc_id", "rater", F.lower(F.trim("subject")).alias("subject"))
    return R.vote(l, "doc_id", "rater", "subject")


def signer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events by the outcome of their signer: registered are signers of verified events, for the scopes they signed."""
    e = table(spark, d, "company_events").select(asof.plain_key(F.col("signer")).alias("k"), F.col("authority_scope").alias("scope"), "verification")
    reg = e.filter("verification = 'verified' and k is not null").select("k", "scope").distinct()
    gone = table(spark, d, "revocations").filter("revoked_scope is null").select(asof.plain_key(F.col("revoked_key")).alias("k")).distinct().withColumn("gone", F.lit(True))
    x = e.join(reg.withColumn("own", F.lit(True)), ["k", "scope"], "left").join(reg.select("k").distinct().withColumn("known", F.lit(True)), "k", "left").join(gone, "k", "left")
    out = R.signer_outcome(F.col("verification") != "foreign", F.col("gone"), F.lit(False), F.col("own"), F.col("known"))
    return x.groupBy(out.alias("outcome")).agg(F.count("*").alias("events"))


def derived_states(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").select("source_kind", "native_id", F.col("delivery_id").alias("reading_id"), F.col("content_digest").alias("digest"), "disposition", "lifecycle", "origin_trust", F.col("observed_at").alias("asserted_at"), F.col("delivered_at").alias("observed_at"))
    return R.derived_states(o)


def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Candidate ids of statements that leave their session: digest of unit, record, owner, destination and payload."""
    s = table(spark, d, "source_records").filter("length(trim(statement)) > 0")
    return s.select("record_id", X.digest_id("cand_", F.coalesce("unit_id", F.lit("")), F.coalesce("native_id", F.lit("")), F.coalesce("owner_id", F.lit("")), F.lit("company"), F.sha2("statement", 256)).alias("candidate_id"))


def direction_index(spark: SparkSession, d: str) -> DataFrame:
    """Sections of accepted decisions: how many rows each has, and its first and last record."""
    s = table(spark, d, "source_records").filter("atom_kind = 'decision' and disposition = 'accepted' and unit_id is not null")
    return s.groupBy(F.substring_index("unit_id", "/", 2).alias("section")).agg(F.count("*").alias("rows"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"))


def mentioned_paths(spark: SparkSession, d: str) -> DataFrame:
    """Relative paths named in statements, by how many records name them."""
    s = table(spark, d, "source_records").select("record_id", F.explode(F.array_distinct(X.path_tokens(F.col("statement")))).alias("path"))
    return s.groupBy("path").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (last_dependants, first_relaxations, prefix_owners, first_citations, rater_votes, signer_outcomes, derived_states, candidate_ids, direction_index, mentioned_paths)}

_NEG = "('rejected', 'reverted', 'retracted', 'withdrawn', 'expired', 'never_true', 'superseded')"
_K = "regexp_replace(lower(trim({c})), '^[^:]*:\\s*', '')"
SQL = {
    "last_dependants": "with f as (select * from source_records where native_id is not null qualify row_number() over (partition by native_id order by record_id) = 1), p as (select native_id as e, asserted_at, record_id, unnest(parents) as fact_id from f), l as (select fact_id, e as dependant from p qualify row_number() over (partition by fact_id order by asserted_at desc nulls last, record_id desc) = 1) select native_id as fact_id, dependant from f left join l on l.fact_id = f.native_id",
    "first_relaxations": f"with k as (select distinct logical_key from source_records where logical_key is not null) select logical_key, min(record_id) as relaxed_by from k left join (select logical_key, record_id from source_records where effective_from <= timestamptz '{AS_OF}+00' and (effective_until is null or effective_until > timestamptz '{AS_OF}+00')) using (logical_key) group by 1",
    "prefix_owners": "with o as (select array_to_string(string_split(unit_id, '/')[1:2], '/') as prefix, min(owner_id) as owner from source_records where owner_id is not null and confidence = 9000 and unit_id is not null group by 1) select path, owner from (select distinct unit_id as path from source_records where unit_id is not null) p join o on path = prefix or starts_with(path, prefix || '/') qualify row_number() over (partition by path order by length(prefix) desc) = 1",
    "first_citations": "with x as (select record_id, unnest(parents) as ref, generate_subscripts(parents, 1) - 1 as position from source_records) select record_id, ref, cast(min(position) as integer) as position from x where ref is not null group by 1, 2",
    "rater_votes": "with s as (select doc_id, rater, list_sort(list(distinct lower(trim(subject)))) as s from subject_labels where doc_id is not null and rater is not null and subject is not null group by 1, 2), n as (select doc_id, s, count(*) as votes from s group by 1, 2), c as (select doc_id, count(*) as kinds, sum(votes) as readings from n group by 1) select doc_id, array_to_string(s, ',') as reading, votes, readings < 2 or kinds > 1 as contested from n join c using (doc_id) qualify row_number() over (partition by doc_id order by votes desc, len(s), array_to_string(s, ',')) = 1",
    "signer_outcomes": f"with e as (select {_K.format(c='signer')} as k, authority_scope as scope, verification from company_events), reg as (select distinct k, scope from e where verification = 'verified' and k is not null), g as (select distinct {_K.format(c='revoked_key')} as k from revocations where revoked_scope is null) select case when not coalesce(verification <> 'foreign', false) then 'signature-invalid' when exists (select 1 from g where g.k = e.k) then 'revoked' when exists (select 1 from reg where reg.k = e.k and reg.scope = e.scope) then 'verified' when exists (select 1 from reg where reg.k = e.k) then 'wrong-scope' else 'unverified' end as outcome, count(*) as events from e group by 1",
    "derived_states": f"""with r as (select *, coalesce(origin_trust <> 'unreviewed-branch', true) as trusted, coalesce(disposition in {_NEG}, false) as neg from observations where native_id is not null),
 h as (select source_kind, native_id, delivery_id as hid, content_digest as hd, observed_at as ha, delivered_at as ho from r where lifecycle = 'observed' and trusted and not neg qualify row_number() over (partition by source_kind, native_id order by observed_at desc nulls last, delivered_at desc nulls last, delivery_id desc) = 1)
 select r.source_kind, r.native_id, delivery_id as reading_id, case when lifecycle <> 'observed' then 'history' when neg then 'withdrawn' when not trusted then 'unverified' when r.source_kind in ('codex_jsonl', 'claude_jsonl') and disposition = 'terminal' then 'terminal'
 when hid = delivery_id then case when disposition in ('draft', 'proposed', 'open', 'incident', 'experiment', 'workaround') then 'proposed' else 'current' end when hd is not distinct from content_digest then 'supports' when r.source_kind in ('repo_code', 'repo_symbols') then 'conflict'
 when r.source_kind in ('command_result', 'repo_tests', 'runtime_evidence') and observed_at < ha and delivered_at > ho then 'late' else 'superseded' end as state from r left join h on h.source_kind is not distinct from r.source_kind and h.native_id = r.native_id""",
    "candidate_ids": "select record_id, 'cand_' || substr(sha256(coalesce(unit_id, '') || chr(0) || coalesce(native_id, '') || chr(0) || coalesce(owner_id, '') || chr(0) || 'company' || chr(0) || sha256(statement)), 1, 40) as candidate_id from source_records where length(trim(statement)) > 0",
    "direction_index": "select array_to_string(string_split(unit_id, '/')[1:2], '/') as section, count(*) as rows, min(record_id) as first_record, max(record_id) as last_record from source_records where atom_kind = 'decision' and disposition = 'accepted' and unit_id is not null group by 1",
    "mentioned_paths": "with w as (select record_id, regexp_replace(unnest(regexp_split_to_array(statement, '[\\s`\"''(),;:]+')), '\\.+$', '') as path from source_records), p as (select distinct record_id, path from w where contains(path, '/') and not starts_with(path, '/') and strlen(path) > 3) select path, count(*) as records from p group by 1",
}
