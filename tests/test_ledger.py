import datetime as dt
import hashlib

from pyspark.sql import functions as F

from ledgerlark.operators import ledger as L
from ledgerlark.operators import projection as P
from ledgerlark.operators import usage as U


def test_reconcile(spark):
    p = [("same", "1", "u", "observed"), ("back", "1", "u", "retracted"), ("away", "1", "u", "observed"), ("changed", "1", "u", "observed"), ("old", "9", "u", "observed"), ("gone", "2", "u", "observed"), ("lost", "3", "w", "observed"), ("old2", "9", "u", "observed"), ("dead", "4", "u", "superseded")]
    s = [("same", "1", True), ("back", "1", True), ("away", "1", False), ("changed", "2", True), ("new", "9", True), ("fresh", "7", True)]
    got = {(r["native_id"], r["digest"], r["change"]) for r in L.reconcile(spark.createDataFrame(p, "native_id string, digest string, unit string, lifecycle string"), spark.createDataFrame(s, "native_id string, digest string, present boolean"), spark.createDataFrame([("u",)], "unit string")).collect()}
    assert got == {("same", "1", "unchanged"), ("back", "1", "observed-again"), ("away", "1", "absent"), ("changed", "1", "superseded"), ("changed", "2", "amended"), ("old", "9", "renamed"), ("new", "9", "new-name"), ("old2", "9", "retracted"), ("gone", "2", "retracted"), ("lost", "3", "absent"), ("fresh", "7", "new")}


def test_sets(spark):
    f = lambda rows: spark.createDataFrame(rows, "g string, m string")
    got = {r["g"]: r["relation"] for r in L.compare_sets(f([("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("a", "1")]), f([("a", "1"), ("b", "1"), ("c", "1"), ("c", "2"), ("d", "2"), ("e", "1")]), "g", "m").collect()}
    assert got == {"a": "equal", "b": "superset", "c": "subset", "d": "incomparable", "e": "subset"}


def test_owners(spark):
    s = spark.createDataFrame([("architecture:c/p/l",), ("architecture:c/x",), ("repo:a",), ("repo:z",), ("repo:two",)], "scope string")
    r = spark.createDataFrame([("architecture:p", "o1"), ("architecture:p/l", "o1"), ("architecture:x", "o2"), ("architecture:x", "o3"), ("repo:a", "o4"), ("repo:two", "o5"), ("repo:two", "o6"), ("fall", "fb")], "scope string, owner string")
    assert {x["scope"]: x["owner"] for x in L.owners(s, r).collect()} == {"architecture:c/p/l": "o1", "architecture:c/x": None, "repo:a": "o4", "repo:z": None, "repo:two": None}
    assert {x["scope"]: x["owner"] for x in L.owners(s, r, "fall").collect()}["repo:z"] == "fb"
    assert {x["owner"] for x in L.owners(s, r, "nowhere").collect()} == {"o1", None, "o4"}


def test_days_pages_and_windows(spark):
    d = spark.createDataFrame([("b", 1, None), ("b", 2, "d1"), ("b", 3, None), ("b", 4, "d2"), ("c", 1, None)], "b string, l int, day string")
    assert [r["day_of"] for r in L.carried_day(d, "b", "l", "day").orderBy("b", "l").collect()] == ["d1", "d1", "d1", "d2", None]
    k = spark.createDataFrame([("k", i) for i in range(7)] + [("m", 9)], "k string, t int")
    assert [r["t"] for r in L.keyset_page(k, "k", "t", ("k", 4), 3).collect()] == [5, 6, 9]
    assert [r["t"] for r in L.newest_window(k, "t", F.lit(100), 400, 250).orderBy("t").collect()] == [6, 9]
    assert [r["t"] for r in L.newest_window(k, "t", F.lit(10_000), 400, 250).collect()] == [9]


def test_merkle(spark):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5)]
    a = [bytes.fromhex(x) for x in leaves]
    while len(a) > 1:
        a = [hashlib.sha256(a[i] + (a[i + 1] if i + 1 < len(a) else a[i])).digest() for i in range(0, len(a), 2)]
    df = spark.createDataFrame(list(enumerate(leaves)), "i int, h string")
    assert L.merkle_root(df, "h", "i") == a[0].hex() and L.merkle_root(df.limit(0), "h", "i") == hashlib.sha256(b"").hexdigest()


def test_skew_and_problems(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(seconds=x), t) for x in (300.9, 301, -300.9, -301, 0)] + [(None, t)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(L.skew(F.col("a"), F.col("b"))).collect()] == [None, "ahead", None, "behind", None, None]
    c = F.col
    rows = spark.createDataFrame([("s", "k", "d", t, None, 1), ("s", "k*", "d", t, None, 1), ("", "k", "d", t, None, 1), ("s", "k", "d", t, t, 1), ("s", "k", "d", t, None, 10_001), (None, None, None, None, None, None), ("a‮b", "k", "d", t, None, 1)], "s string, k string, d string, f timestamp, u timestamp, c int")
    assert [r[0] for r in rows.select(L.fact_problem(c("s"), c("k"), c("d"), c("f"), c("u"), c("c"))).collect()] == [None, "wildcard-key", "empty-statement", "inverted-validity", "confidence-out-of-range", "missing-key", "control-characters"]


def test_projection_equals_a_plain_loop(spark):
    import random

    r = random.Random(5)
    words = "cache ledger shard token gate queue rotation manifest digest walker records drafts events".split()
    rows = [(f"f{i:03}", f"k/{r.randrange(30)}", " ".join(r.sample(words, 4)), r.choice(["constraint", "decision", "rationale", "observation", "claim"]), r.choice(["company", "codebase"]), "repo", r.choice([9000, 7500, 3000]), r.choice([0, 9000]), r.randrange(5), [r.choice("abcdefgh")], "") for i in range(300)]
    f = spark.createDataFrame(rows, "fact_id string, logical_key string, statement string, atom_kind string, store_kind string, authority_scope string, loss int, confidence int, independent int, support array<string>, trigger string")
    c = P.candidates(f, "keep the cache", "which ledger", spark.createDataFrame([(s, 3000) for s in {x[2] for x in rows[:100]}], "statement string, bp int"))
    whole = P.greedy(c.collect(), P.ITEMS, P.BYTES, None)
    assert [tuple(x) for x in P.select(c, shortlist=3).orderBy("position").collect()] == whole and len(whole) == P.ITEMS
    assert [tuple(x) for x in P.select(c, shortlist=3, most=10).orderBy("position").collect()] == whole
    assert P.select(c.limit(0)).count() == 0


def test_usage_window_is_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        U.in_window(spark.range(1), "2024-02-01", "2024-01-01")


def test_symbols_of_many_sites_come_out_per_site(spark, tmp_path):
    from ledgerlark.plans.ledger import symbols_conflict

    rows = [(i, f"site{k}", native, f"shape{k % 2}") for i, (native, k) in enumerate([("hot", k) for k in range(9)] + [("eight", k) for k in range(8)] + [("one", 0), ("one", 0)])]
    df = spark.createDataFrame(rows, "delivery_id bigint, source_identity string, native_id string, content_digest string")
    at = F.timestamp_seconds("delivery_id")
    df.select("*", at.alias("observed_at"), at.alias("delivered_at")).write.parquet(str(tmp_path / "observations.parquet"))
    got = sorted(tuple(r) for r in symbols_conflict(spark, str(tmp_path)).collect())
    assert got == [("eight", 8, "conflict")] + [("hot", 9, "current")] * 9 + [("one", 1, "current")]
