"""Closed vocabularies, the standing lattice and the authority rank, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the ledger format.
STANDINGS = ["authoritative", "ratified", "enforced", "exemplary", "prevalent", "present", "unruled"]
CEILINGS = {"human": "authoritative", "human_review": "prevalent", "transcript": "prevalent"}
NEGATIVE = ["rejected", "reverted", "retracted", "withdrawn", "expired", "never_true", "superseded"]
TRANSIENT = ["draft", "proposed", "open", "incident", "experiment", "workaround"]
DURABLE = ["approved", "accepted", "merged", "deployed", "current"]
RULING_KINDS = ["north_star", "directional", "invariant"]
STANDING_RANK = {"authoritative": 12, "ratified": 11, "enforced": 10, "exemplary": 9, "prevalent": 8, "unruled": 0}
DEFAULT_LOSS = {"constraint": 9000, "decision": 7500, "relaxation": 7000, "reference": 6000, "rationale": 5000, "question": 5000, "claim": 4500}
BASIS_POINTS = {"high": 9000, "critical": 9000, "safety": 9000, "safety_critical": 9000, "irreversible": 9000, "medium": 6000, "moderate": 6000, "low": 3000, "advisory": 3000, "reversible": 3000, "none": 0, "": 0}
EXPIRY_DAYS = 7
VERIFICATION_REASONS = {"unverified": "UNVERIFIED", "foreign": "FOREIGN_REPO_EVENTS", "signature-invalid": "SIGNATURE_INVALID", "revoked": "REVOKED", "wrong-scope": "AUTHORITY_WRONG_SCOPE"}
DECAY_POLICY = [("observation", "newest-cursor-within-same-source"), ("claim", "conflict-unless-superseded"), ("decision", "conflict-unless-superseded"), ("constraint", "conflict-unless-superseded"), ("rationale", "accumulate")]


def pick(c: Column, table: dict, default=None) -> Column:
    """CASE over a literal map; null stays on the default."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def strength(standing: Column) -> Column:
    """0 is the strongest; unknown and null values rank last."""
    return pick(standing, {s: i for i, s in enumerate(STANDINGS)}, len(STANDINGS))


def effective_standing(standing: Column, provenance: Column) -> Column:
    """The claimed standing (default ``present``), no stronger than what the provenance allows."""
    claimed = F.coalesce(standing, F.lit("present"))
    ceiling = pick(provenance, CEILINGS, "present")
    return F.when(strength(claimed) < strength(ceiling), ceiling).otherwise(claimed)


def authority_rank(store: Column, scope: Column, standing: Column, trust: Column, authorized: Column, disposition: Column, kind: Column, candidate: Column | None = None) -> Column:
    """Rank of an event: an untrusted codebase origin is 0 whatever it claims, then standing decides, then the store."""
    untrusted = (store == "codebase") & trust.isNotNull() & (trust != "merged-default") & ~((trust == "approved-pr") & F.coalesce(authorized, F.lit(False)))
    env, arch = scope.startswith("environment:"), scope.startswith("architecture:")
    approved = F.coalesce(disposition == "approved", F.lit(False)) | kind.isin("constraint", "decision")
    if candidate is not None:
        approved = approved | candidate
    by_store = F.when(store == "company", F.when(arch, 6).when(env, 3).otherwise(5)).when(store == "codebase", F.when(env, 3).when(approved, 4).otherwise(2)).otherwise(1)
    return F.when(F.coalesce(untrusted, F.lit(False)), 0).otherwise(F.coalesce(pick(standing, STANDING_RANK), by_store)).cast("int")


def expiry(until: Column, start: Column, disposition: Column) -> Column:
    """The declared end, else seven days after the start for transient dispositions, else null."""
    return F.coalesce(until, F.when(disposition.isin(*TRANSIENT), start + F.expr(f"interval {EXPIRY_DAYS} days")))


def basis_points(c: Column) -> Column:
    """Words and integers 0..10000 to basis points; anything else is null."""
    word = F.lower(F.trim(c))
    number = F.try_to_number(word, F.lit("99999")).cast("int")
    return F.coalesce(pick(word, BASIS_POINTS), F.when((number >= 0) & (number <= 10_000), number))
