"""The reducer: signed events to a deterministic view of what is current, per logical key, as of an instant.

Every step partitions by logical_key, except governance, whose rules are first reduced to one row per path. Input columns
(``admitted``): logical_key, event_id, fact_id, store_kind, authority_scope, statement_id, atom_kind, disposition, standing,
provenance, origin_trust, authorized, reachable, verification, environment_registered, source_identity, signer, cursor,
asserted_at, effective_from, effective_until, parents, supersedes, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.functions import lattice as L
from ledgerlark.session import cut

KEY = "logical_key"


def governance_rules(events: DataFrame) -> DataFrame:
    """(path, first, first_fact, first_standing, second, second_standing): of each path the earliest rule, and the earliest of
    another fact. ``events`` has rule_index, path, standing, fact_id. A ruling never demotes its own fact."""
    one = events.groupBy("path", "fact_id").agg(F.min(F.struct("rule_index", "standing")).alias("r"))
    w = W.partitionBy("path").orderBy("r.rule_index", "fact_id")
    n = one.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    at = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    return n.groupBy("path").agg(at(1, "r.rule_index").alias("first"), at(1, "fact_id").alias("first_fact"), at(1, "r.standing").alias("first_standing"), at(2, "r.rule_index").alias("second"), at(2, "r.standing").alias("second_standing"))


def with_standing(admitted: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds ``own`` and ``governed`` standing and ``rank``. Rules match by path prefix: an event meets the rules of all
    prefixes of its path that end at a separator or at the whole path, in an equi-join."""
    e = admitted.withColumn("own", L.effective_standing(F.col("standing"), F.col("provenance")))
    if rules is None:
        e = e.withColumn("governed", F.col("own"))
    else:
        parts = F.split("path", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        hits = e.filter("path is not null").select("event_id", "fact_id", F.explode(prefixes).alias("path")).join(governance_rules(rules), "path")
        own = F.col("fact_id").eqNullSafe(F.col("first_fact"))
        hit = F.struct(F.when(own, F.col("second")).otherwise(F.col("first")).alias("i"), F.when(own, F.col("second_standing")).otherwise(F.col("first_standing")).alias("s"))
        best = hits.select("event_id", hit.alias("h")).filter("h.i is not null").groupBy("event_id").agg(F.min("h").alias("rule"))
        demoted = F.col("own").isin("prevalent", "present") & (L.strength(F.col("rule.s")) < L.strength(F.col("own")))
        e = e.join(best, "event_id", "left").withColumn("governed", F.when(F.coalesce(demoted, F.lit(False)), "present").otherwise(F.col("own"))).drop("rule")
    c = F.col
    return e.withColumn("rank", L.authority_rank(c("store_kind"), c("authority_scope"), c("governed"), c("origin_trust"), c("authorized"), c("disposition"), c("atom_kind")))


def with_reason(ranked: DataFrame, revocations: DataFrame, store: str, authority_cursor: int | None = None) -> DataFrame:
    """Adds ``reason``, null for eligible events: the first failing test in the fixed order. ``revocations``: key, scope,
    effective_at, cursor bigint, observed. They count if observed, or up to the authority cursor."""
    seen = revocations.filter(F.col("observed") | (F.col("cursor") <= F.lit(authority_cursor) if authority_cursor is not None else F.lit(False)))
    everywhere = seen.filter("scope is null").groupBy(F.col("key").alias("signer")).agg(F.min("effective_at").alias("_all"))
    scoped = seen.filter("scope is not null").groupBy(F.col("key").alias("signer"), F.col("scope").alias("authority_scope")).agg(F.min("effective_at").alias("_scoped"))
    e = ranked.join(everywhere, "signer", "left").join(scoped, ["signer", "authority_scope"], "left")
    revoked = F.least("_all", "_scoped") <= F.col("asserted_at")
    reason = (
        F.when(F.col("environment_registered") == F.lit(False), "ENVIRONMENT_UNREGISTERED")
        .when(F.col("verification") != "verified", L.pick(F.col("verification"), L.VERIFICATION_REASONS, "UNVERIFIED"))
        .when(revoked, "REVOKED")
        .when((F.col("store_kind") != store) & F.lit(store != "mixed"), "WRONG_STORE")
        .when((F.col("rank") == 0) | (F.col("reachable") == F.lit(False)), "UNTRUSTED_BRANCH")
    )
    return e.withColumn("reason", reason).withColumn("revoked_later", F.least("_all", "_scoped").isNotNull()).drop("_all", "_scoped")


def retirements(eligible: DataFrame, tombstones: DataFrame, all_ids: DataFrame) -> DataFrame:
    """(logical_key, event_id, why): what is retired in each key. The last writer in event order wins, then the kind of step
    within one event: parents, resolver, retraction, itself, supersession; tombstones come last of all."""
    e = eligible.select(KEY, "event_id", "cursor", "rank", "authority_scope", "statement_id", "disposition", "parents", "supersedes")
    old = eligible.select(KEY, F.col("event_id").alias("target"), F.col("rank").alias("old_rank"), F.col("authority_scope").alias("old_scope"), F.col("statement_id").alias("old_statement"))
    owns = (F.col("old_rank") <= F.col("rank")) & F.col("old_scope").eqNullSafe(F.col("authority_scope"))
    by = e.filter(F.size("parents") >= 2).withColumn("target", F.explode("parents")).join(old, [KEY, "target"]).withColumn("owns", owns)
    step = lambda df, target, n, why: df.select(KEY, F.col(target).alias("event_id"), F.col("cursor").alias("at"), F.lit(n).alias("step"), F.lit(why).alias("why"), F.col("event_id").alias("by"))
    no_super = F.coalesce(F.size("supersedes"), F.lit(0)) <= 0
    resolved = step(by.filter(F.col("owns") & no_super), "target", 1, "resolved")
    set_aside = step(by.filter(~F.col("owns") & ~F.col("old_statement").eqNullSafe(F.col("statement_id"))), "event_id", 2, "unauthorized")
    gone = e.filter(F.col("disposition").isin("retracted", "withdrawn"))
    listed = F.concat(F.coalesce("supersedes", F.array().cast("array<string>")), F.coalesce("parents", F.array().cast("array<string>")))
    retracted = step(gone.withColumn("target", F.explode(listed)), "target", 3, "retracted")
    itself = step(gone, "event_id", 4, "self-retraction")
    named = e.filter(~F.coalesce(F.col("disposition").isin("retracted", "withdrawn", "rejected", "reverted"), F.lit(False))).withColumn("target", F.explode("supersedes"))
    inside = step(named.join(old, [KEY, "target"]).filter(owns), "target", 5, "superseded")
    outside = step(named.join(old.select(KEY, "target"), [KEY, "target"], "left_anti").join(all_ids.select(F.col("event_id").alias("target")).distinct(), "target", "left_semi"), "target", 5, "superseded")
    dead = eligible.select(KEY, "event_id").join(tombstones.filter("signer_authorized and kind = 'never_true'").select(F.col("target_event_id").alias("event_id"), F.col("tombstone_id").alias("by")), "event_id").select(KEY, "event_id", F.lit((1 << 62)).alias("at"), F.lit(6).alias("step"), F.lit("never_true").alias("why"), "by")
    rows = resolved
    for x in (set_aside, retracted, itself, inside, outside, dead):
        rows = rows.unionByName(x)
    return rows.groupBy(KEY, "event_id").agg(F.max_by("why", F.struct("at", "by", "step")).alias("why"))


def live_events(eligible: DataFrame, retired: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``stage``: RETIRED, NEGATIVE, NOT_YET_EFFECTIVE, EXPIRED or LIVE."""
    e = eligible.join(retired.withColumnRenamed("why", "retired"), [KEY, "event_id"], "left")
    stage = (
        F.when(F.col("retired").isNotNull(), "RETIRED")
        .when(F.col("disposition").isin(*L.NEGATIVE), "NEGATIVE")
        .when(F.col("effective_from") > as_of, "NOT_YET_EFFECTIVE")
        .when(L.expiry(F.col("effective_until"), F.col("effective_from"), F.col("disposition")) <= as_of, "EXPIRED")
        .otherwise("LIVE")
    )
    return e.withColumn("stage", stage)


def clusters(staged: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row per (key, statement) of live events: support, independent sources, rank, oldest and newest member, whether a
    notice withholds it, and whether all of its support was revoked. Partial aggregation carries a hot key."""
    t = tombstones.filter("signer_authorized").groupBy(F.col("target_event_id").alias("event_id")).agg(F.bool_or(F.col("kind") == "support_withdrawn").alias("unsupported"), F.bool_or(F.col("kind") == "misextraction").alias("noticed"))
    e = staged.filter("stage = 'LIVE'").join(t, "event_id", "left").filter("not coalesce(unsupported, false)")
    ok = ~F.col("revoked_later")
    of = lambda c: F.when(ok, c)
    source = F.coalesce("source_identity", F.concat_ws("|", "store_kind", "signer"))
    member = F.struct("cursor", "event_id", "fact_id", "atom_kind", "store_kind", "authority_scope", "disposition", "source_identity")
    return e.groupBy(KEY, "statement_id").agg(
        F.count_if(ok).alias("support"), F.countDistinct(of(source)).alias("independent"), F.max(of(F.col("rank"))).alias("rank"), F.min(of(member)).alias("first"), F.max(of(F.struct("cursor", "event_id"))).alias("newest"),
        F.coalesce(F.bool_or(of(F.coalesce("noticed", F.lit(False)))), F.lit(False)).alias("withheld"), (~F.bool_or(ok)).alias("all_revoked"),
    )


def heads(clustered: DataFrame) -> DataFrame:
    """Clusters with ``outcome``: CURRENT, CONFLICT, DECAYED, ACCUMULATED, PROPOSED_NOT_ACCEPTED, DEFEATED_BY_RUNTIME, CONTRADICTED.

    Whole-key statistics are aggregates, pre-aggregated before the shuffle and joined back, so a key of any share of the rows
    neither passes through one window nor is collected; AQE splits its join.
    """
    c = clustered.filter("not all_revoked").select("*", "first.*").drop("first")
    c = c.join(c.groupBy(KEY).agg(F.max("rank").alias("top_rank")), KEY).withColumn("top", F.col("rank") == F.col("top_rank"))
    arch = F.col("top") & (F.col("store_kind") == "company") & F.col("authority_scope").startswith("architecture:")
    c = c.withColumn("drift", ~F.col("top") & (F.col("store_kind") == "codebase") & F.coalesce(F.col("disposition").isin(*L.DURABLE), F.lit(False)))
    mine = F.when(F.col("top"), F.coalesce("source_identity", F.lit("")))
    on_top = lambda x: F.when(F.col("top"), x)
    name = F.struct("fact_id", "statement_id")
    stats = c.groupBy(KEY).agg(
        F.count_if("top").alias("tops"), F.min(on_top((F.col("atom_kind") == "observation").cast("int"))).alias("observed"), F.min(on_top((F.col("atom_kind") == "rationale").cast("int"))).alias("reasons"),
        (F.min(mine) == F.max(mine)).alias("one_source"), (F.max(arch.cast("int")) + F.max(F.col("drift").cast("int")) == 2).alias("arch_drift"),
        F.min(on_top(F.struct((-F.col("newest.cursor")).alias("c"), name.alias("n")))).alias("newest_top"), F.min(on_top(name)).alias("first_top"),
    )
    c = c.join(stats, KEY).withColumn("name", name)
    several = F.col("tops") > 1
    decays = several & (F.col("observed") == 1) & F.col("one_source")
    adds_up = several & ~decays & (F.col("reasons") == 1)
    conflict = several & ~decays & ~adds_up
    drifting = ~several & F.col("arch_drift")
    chosen = F.when(decays, F.col("top") & (F.col("name") == F.col("newest_top.n"))).when(adds_up, F.col("top") & (F.col("name") == F.col("first_top"))).otherwise(F.col("top") & ~conflict & ~drifting)
    c = c.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    live = c.filter("chosen and authority_scope like 'environment:%' and atom_kind = 'observation'").select(KEY, F.lit(True).alias("_runtime")).distinct()
    c = c.join(live, KEY, "left")
    runtime = F.coalesce("_runtime", F.lit(False))
    outcome = (
        F.when(F.col("chosen"), "CURRENT").when(F.col("top") & decays, "DECAYED").when(F.col("top") & adds_up, "ACCUMULATED").when((F.col("top") & (conflict | drifting)) | (drifting & F.col("drift")), "CONFLICT")
        .when(F.col("disposition").isin(*L.TRANSIENT), "PROPOSED_NOT_ACCEPTED").when(runtime & ~F.col("authority_scope").startswith("environment:"), "DEFEATED_BY_RUNTIME").otherwise("CONTRADICTED")
    )
    return c.withColumn("outcome", outcome).select(KEY, "statement_id", "event_id", "fact_id", "support", "independent", "rank", "withheld", "outcome")


def key_outcomes(reasoned: DataFrame, staged: DataFrame, clustered: DataFrame, head: DataFrame) -> DataFrame:
    """One row per key: environment first, then conflict, a current head, else why nothing survives."""
    per = reasoned.groupBy(KEY).agg(F.bool_or(F.coalesce(F.col("reason") == "ENVIRONMENT_UNREGISTERED", F.lit(False))).alias("env"), F.bool_or(F.coalesce(F.col("reason") == "REVOKED", F.lit(False))).alias("revoked"), F.bool_or(F.col("reason").isNotNull()).alias("rejected"))
    st = staged.groupBy(KEY).agg(F.bool_or(F.col("stage").isin("EXPIRED", "NOT_YET_EFFECTIVE")).alias("expired"), F.bool_or(F.col("stage") == "NEGATIVE").alias("negative"), F.bool_or(F.col("stage") == "RETIRED").alias("retired"), F.count_if(F.col("stage") == "LIVE").alias("live"))
    cl = clustered.groupBy(KEY).agg(F.bool_or("all_revoked").alias("support_revoked"), F.sum("support").alias("supported"))
    hd = head.groupBy(KEY).agg(F.bool_or(F.col("outcome") == "CONFLICT").alias("conflict"), F.bool_or(F.col("outcome") == "CURRENT").alias("current"))
    no = F.lit(False)
    x = per.join(st, KEY, "left").join(cl, KEY, "left").join(hd, KEY, "left").fillna(False, ["expired", "negative", "retired", "support_revoked", "conflict", "current"])
    unsupported = F.coalesce(F.col("live") > 0, no) & F.col("support_revoked").eqNullSafe(F.lit(False)) & (F.coalesce("supported", F.lit(0)) == 0)
    state = F.when(F.col("env"), "environment-registry").when(F.col("conflict"), "conflict").when(F.col("current"), "current").when(F.col("support_revoked") | F.col("revoked"), "revoked").when(unsupported, "withdrawn").when(F.col("expired"), "expired").when((F.col("rejected") | F.col("retired")) & ~F.col("negative"), "unverified").otherwise("withdrawn")
    return x.select(KEY, state.alias("state"))


def unknown_id(store: Column, key: Column, kind: Column, evidence: Column) -> Column:
    return F.concat(F.lit("unknown_"), F.substring(F.sha2(F.concat_ws("\u0000", store, key, kind, evidence), 256), 1, 40))


class View:
    """All tables of one reduction: reasoned, eligible, retired, staged, clusters, heads, outcomes. The three that later steps read
    several times are written once to the shared folder."""

    def __init__(self, admitted: DataFrame, revocations: DataFrame, tombstones: DataFrame, as_of: str, store: str = "mixed", rules: DataFrame | None = None, authority_cursor: int | None = None):
        self.reasoned = cut(with_reason(with_standing(admitted, rules), revocations, store, authority_cursor))
        self.eligible = self.reasoned.filter("reason is null")
        self.retired = retirements(self.eligible, tombstones, admitted)
        self.staged = cut(live_events(self.eligible, self.retired, F.lit(as_of).cast("timestamp")))
        self.clusters = cut(clusters(self.staged, tombstones))
        self.heads = heads(self.clusters)
        self.outcomes = key_outcomes(self.reasoned, self.staged, self.clusters, self.heads)

    def counts(self) -> DataFrame:
        return self.outcomes.groupBy("state").agg(F.count("*").alias("keys"))

    def unknowns(self) -> DataFrame:
        """One unknown per key that isn't current."""
        k = self.outcomes.filter("state != 'current'")
        return k.select(KEY, F.col("state").alias("kind"), unknown_id(F.lit("mixed"), F.col(KEY), F.col("state"), F.lit("")).alias("unknown_id"))
