"""Joins and votes of the ledger that are more than one equi-join: first matches, last dependants, prefixes, citations,
self-consistency, signers, and the derived state of observed readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import lattice as L


def last_dependant(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Of each fact (fact_id) the event (event_id, parents, asserted_at, position) that names it as a parent and was asserted
    last; on ties the last in input order. Facts without one keep null; a hot fact is pre-aggregated."""
    named = events.select("event_id", "asserted_at", "position", F.explode("parents").alias("fact_id"))
    last = named.groupBy("fact_id").agg(F.max_by("event_id", F.struct("asserted_at", "position")).alias("dependant"))
    return facts.select("fact_id").distinct().join(last, "fact_id", "left")


def first_match(left: DataFrame, right: DataFrame, on: list[str], valid: Column, order: list[str], take: str) -> DataFrame:
    """``left`` with ``take`` of the first row of ``right`` (by ``order``) that agrees on ``on`` and is valid; the candidates are
    reduced to one per key before the join."""
    one = right.filter(valid).groupBy(*on).agg(F.min_by(take, F.struct(*order)).alias(take))
    return left.join(one, on, "left")


def prefix_owner(paths: DataFrame, owned: DataFrame) -> DataFrame:
    """(path, owner): the owner of the longest owned prefix that ends at a path part. An equi-join on the few prefixes of each
    path, not a comparison of all pairs. Several owners of one prefix: the least."""
    parts = F.split("path", "/")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix")))
    own = owned.filter("prefix is not null").groupBy("prefix").agg(F.min("owner").alias("owner"))
    hit = paths.select("path").filter("path is not null").distinct().select("path", F.explode(pre).alias("p")).select("path", "p.*").join(own, "prefix")
    return hit.groupBy("path").agg(F.max_by("owner", "n").alias("owner"))


def first_citations(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """Each cited reference once per ``key``, at its first position."""
    x = rows.select(key, F.posexplode(refs).alias("position", "ref"))
    return x.filter("ref is not null").groupBy(key, "ref").agg(F.min("position").alias("position"))


def vote(readings: DataFrame, item: str, reader: str, label: str) -> DataFrame:
    """The reading (sorted set of labels) that most readers of an item give; ties go to the smaller set, then the lesser text.
    Also whether it's contested: fewer than two readings, or any that differs. A reader has few labels per item."""
    sets = readings.filter(F.col(item).isNotNull() & F.col(reader).isNotNull() & F.col(label).isNotNull()).groupBy(item, reader).agg(F.array_sort(F.collect_set(label)).alias("s"))
    n = sets.groupBy(item, "s").agg(F.count("*").alias("votes"))
    best = n.groupBy(item).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.size("s").alias("k"), F.array_join("s", ",").alias("reading"))).alias("b"), F.count("*").alias("kinds"), F.sum("votes").alias("readings"))
    return best.select(item, F.col("b.reading").alias("reading"), (-F.col("b.v")).alias("votes"), ((F.col("readings") < 2) | (F.col("kinds") > 1)).alias("contested"))


def signer_outcome(valid: Column, revoked: Column, steward: Column, owns_scope: Column, registered: Column) -> Column:
    """Outcome of a signer: signature first, then revocation, stewardship, the exact scope, any registration."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(valid), "signature-invalid").when(yes(revoked), "revoked").when(yes(steward) | yes(owns_scope), "verified").when(yes(registered), "wrong-scope").otherwise("unverified")


def rotate(keys: dict[str, str], rotations: list[tuple[int, str, str]]) -> dict[str, str]:
    """Current key of each authority after a chain of rotations (cursor, old key, new key), which apply in cursor order: one
    fold over a short administrative list."""
    keys = dict(keys)
    for _, old, new in sorted(rotations):
        for who, k in keys.items():
            if k == old:
                keys[who] = new
    return keys


def lifted(revocations: DataFrame, registrations: DataFrame) -> DataFrame:
    """Revocations (key, cursor) that no later registration (key, cursor) lifts."""
    last = registrations.groupBy("key").agg(F.max("cursor").alias("again"))
    return revocations.join(last, "key", "left").filter("again is null or again <= cursor").drop("again")


def derived_states(readings: DataFrame) -> DataFrame:
    """State of each reading against the head of its native id.

    ``readings``: source_kind, native_id, reading_id, digest, disposition, lifecycle, origin_trust, asserted_at, observed_at.
    Rows that aren't observed any more are history. The head is the last eligible reading by (asserted, observed, id), nulls
    first; transcripts end, code supports or conflicts with its head, ordered evidence is superseded or late, ledgers of
    decisions follow their disposition.
    """
    trusted = F.coalesce(F.col("origin_trust") != "unreviewed-branch", F.lit(True))
    fresh = (F.col("lifecycle") == "observed") & trusted & ~F.coalesce(F.col("disposition").isin(*L.NEGATIVE), F.lit(False))
    r = readings.filter("native_id is not null").withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    order = F.struct("asserted_at", "observed_at", "reading_id")
    head = r.filter("fresh").groupBy("source_kind", "native_id").agg(F.max(F.struct(order.alias("o"), F.col("digest").alias("d"))).alias("h"))
    x = r.join(head, ["source_kind", "native_id"], "left")
    is_head = F.col("h.o.reading_id") == F.col("reading_id")
    same = F.col("h.d").eqNullSafe(F.col("digest"))
    late = (F.col("asserted_at") < F.col("h.o.asserted_at")) & (F.col("observed_at") > F.col("h.o.observed_at"))
    kind = F.col("source_kind")
    code, personal, ordered = kind.isin("repo_code", "repo_symbols"), kind.isin("codex_jsonl", "claude_jsonl"), kind.isin("command_result", "repo_tests", "runtime_evidence")
    state = (
        F.when(F.col("lifecycle") != "observed", "history").when(F.col("disposition").isin(*L.NEGATIVE), "withdrawn").when(~trusted, "unverified").when(personal & (F.col("disposition") == "terminal"), "terminal")
        .when(is_head, F.when(F.col("disposition").isin(*L.TRANSIENT), "proposed").otherwise("current")).when(same, "supports").when(code, "conflict").when(ordered & late, "late").otherwise("superseded")
    )
    return x.select("source_kind", "native_id", "reading_id", state.alias("state"))


