import datetime as dt

import pytest

from ledgerlark.functions import lattice as L
from ledgerlark.operators import reduce as R
from pyspark.sql import functions as F

T = lambda d: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d)
BASE = dict(logical_key="k", event_id="e1", fact_id="f1", store_kind="codebase", authority_scope="repo:a", statement_id="s1", atom_kind="decision", disposition="accepted", standing="present", provenance="human", origin_trust=None, authorized=False, reachable=True, verification="verified", environment_registered=None, source_identity="src", signer="key", cursor=1, asserted_at=T(0), effective_from=T(0), effective_until=None, parents=[], supersedes=[], path="a/b")
SCHEMA = "logical_key string, event_id string, fact_id string, store_kind string, authority_scope string, statement_id string, atom_kind string, disposition string, standing string, provenance string, origin_trust string, authorized boolean, reachable boolean, verification string, environment_registered boolean, source_identity string, signer string, cursor bigint, asserted_at timestamp, effective_from timestamp, effective_until timestamp, parents array<string>, supersedes array<string>, path string"


def view(spark, *events, tombstones=(), revocations=(), rules=None, store="mixed"):
    rows = []
    for i, e in enumerate(events):
        x = BASE | dict(event_id=f"e{i + 1}", fact_id=f"f{i + 1}", statement_id=f"s{i + 1}", cursor=i + 1) | e
        rows.append(tuple(x[c.split()[0]] for c in SCHEMA.split(", ")))
    t = spark.createDataFrame(list(tombstones), "kind string, target_event_id string, signer_authorized boolean, tombstone_id string")
    v = spark.createDataFrame(list(revocations), "key string, scope string, effective_at timestamp, cursor bigint, observed boolean")
    r = spark.createDataFrame(rules, "rule_index bigint, path string, standing string, fact_id string") if rules else None
    return R.View(spark.createDataFrame(rows, SCHEMA), v, t, "2024-06-01", store, r)


def states(v):
    return {r["logical_key"]: r["state"] for r in v.outcomes.collect()}, {r["event_id"]: r["outcome"] for r in v.heads.collect()}


CASES = {
    "a newer rejected change never wins": ([{}, {"disposition": "rejected"}], {}, "current", {"e1": "CURRENT"}),
    "repetition is not independence": ([{"standing": "ratified"}] + [{"statement_id": "copy"}] * 10, {}, "current", {"e1": "CURRENT", "e2": "CONTRADICTED"}),
    "supersession retires": ([{}, {"supersedes": ["e1"]}], {}, "current", {"e2": "CURRENT"}),
    "supersession needs the scope": ([{}, {"supersedes": ["e1"], "authority_scope": "repo:b"}], {}, "conflict", {"e1": "CONFLICT", "e2": "CONFLICT"}),
    "a workaround expires": ([{"disposition": "workaround"}], {}, "expired", {}),
    "two equal heads conflict": ([{}, {}], {}, "conflict", {"e1": "CONFLICT", "e2": "CONFLICT"}),
    "a resolver with both parents wins": ([{}, {}, {"parents": ["e1", "e2"]}], {}, "current", {"e3": "CURRENT"}),
    "an unauthorised resolver is set aside": ([{}, {}, {"parents": ["e1", "e2"], "authority_scope": "repo:x"}], {}, "conflict", {"e1": "CONFLICT", "e2": "CONFLICT"}),
    "unreviewed branch": ([{"origin_trust": "unreviewed-branch", "standing": "authoritative"}], {}, "unverified", {}),
    "approved pr needs authorisation": ([{"origin_trust": "approved-pr"}, {"origin_trust": "approved-pr", "authorized": True}], {}, "current", {"e2": "CURRENT"}),
    "unregistered environment comes first": ([{}, {"environment_registered": False}], {}, "environment-registry", {"e1": "CURRENT"}),
    "observations decay to the newest": ([{"atom_kind": "observation"}, {"atom_kind": "observation"}], {}, "current", {"e1": "DECAYED", "e2": "CURRENT"}),
    "rationales add up": ([{"atom_kind": "rationale"}, {"atom_kind": "rationale"}], {}, "current", {"e1": "CURRENT", "e2": "ACCUMULATED"}),
    "architecture drift": ([{"store_kind": "company", "authority_scope": "architecture:a"}, {"disposition": "merged"}], {}, "conflict", {"e1": "CONFLICT", "e2": "CONFLICT"}),
    "a draft below stays a proposal": ([{"standing": "ratified"}, {"disposition": "draft", "effective_until": T(400)}], {}, "current", {"e1": "CURRENT", "e2": "PROPOSED_NOT_ACCEPTED"}),
    "runtime defeats a default": ([{"authority_scope": "environment:p", "atom_kind": "observation", "standing": "enforced"}, {}], {}, "current", {"e1": "CURRENT", "e2": "DEFEATED_BY_RUNTIME"}),
    "retraction needs no rank": ([{"standing": "authoritative"}, {"disposition": "retracted", "supersedes": ["e1"]}], {}, "unverified", {}),
    "never true": ([{}], {"tombstones": [("never_true", "e1", True, "t")]}, "unverified", {}),
    "an unauthorised tombstone does nothing": ([{}], {"tombstones": [("never_true", "e1", False, "t")]}, "current", {"e1": "CURRENT"}),
    "support withdrawn": ([{}], {"tombstones": [("support_withdrawn", "e1", True, "t")]}, "withdrawn", {}),
    "revoked before": ([{}], {"revocations": [("key", None, T(-1), 1, True)]}, "revoked", {}),
    "revoked later takes the support": ([{}], {"revocations": [("key", None, T(9), 1, True)]}, "revoked", {}),
    "revoked in another scope": ([{}], {"revocations": [("key", "repo:z", T(-1), 1, True)]}, "current", {"e1": "CURRENT"}),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    events, more, state, heads = CASES[name]
    got, h = states(view(spark, *events, **more))
    assert got == {"k": state} and h == heads


def test_misextraction_withholds(spark):
    v = view(spark, {}, tombstones=[("misextraction", "e1", True, "t")])
    assert [r["withheld"] for r in v.heads.collect()] == [True]


def test_rules_demote_ambient_evidence_by_whole_path_parts(spark):
    v = view(spark, {"standing": "prevalent", "path": "src/pay/x"}, {"standing": "prevalent", "path": "src/payment/x"}, {"standing": "enforced", "path": "src/pay"}, {"standing": "prevalent", "path": "src/pay", "fact_id": "rule"}, rules=[(1, "src/pay", "ratified", "rule")])
    assert {r["event_id"]: r["governed"] for r in v.reasoned.collect()} == {"e1": "present", "e2": "prevalent", "e3": "enforced", "e4": "prevalent"}


def test_order_of_rows_does_not_matter_and_empty_input(spark):
    v = view(spark, {}, {"supersedes": ["e1"]}, {"logical_key": "z", "disposition": "draft"})
    w = view(spark, *[{"event_id": f"e{i}", "fact_id": f"f{i}", "statement_id": f"s{i}", "cursor": i, **x} for i, x in ((3, {"logical_key": "z", "disposition": "draft"}), (2, {"supersedes": ["e1"]}), (1, {}))])
    assert states(v) == states(w)
    assert states(view(spark))[0] == {}


def test_lattice(spark):
    rows = spark.createDataFrame([("authoritative", "bot"), ("unruled", "bot"), (None, "human"), ("odd", None)], "s string, p string")
    assert [r[0] for r in rows.select(L.effective_standing(F.col("s"), F.col("p"))).collect()] == ["present", "unruled", "present", "odd"]
    bp = spark.createDataFrame([("high",), ("250",), ("10001",), (None,), ("x",)], "b string").select(L.basis_points(F.col("b"))).collect()
    assert [r[0] for r in bp] == [9000, 250, None, None, None]
