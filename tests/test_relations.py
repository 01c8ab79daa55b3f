import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.operators import relations as R

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def test_last_dependant_keeps_the_last_on_ties(spark):
    e = spark.createDataFrame([("e1", ["f", "g"], T(1), 1), ("e2", ["f"], T(2), 2), ("e3", ["f"], T(2), 3), ("e4", None, T(9), 4)], "event_id string, parents array<string>, asserted_at timestamp, position int")
    f = spark.createDataFrame([("f",), ("g",), ("h",), ("f",)], "fact_id string")
    assert {r["fact_id"]: r["dependant"] for r in R.last_dependant(f, e).collect()} == {"f": "e3", "g": "e1", "h": None}


def test_first_match_and_prefixes(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 3, True), ("a", 2, False), ("a", 5, True), ("c", 1, True)], "k string, n int, ok boolean")
    assert {r["k"]: r["n"] for r in R.first_match(left, right, ["k"], F.col("ok"), ["n"], "n").collect()} == {"a": 3, "b": None}
    own = spark.createDataFrame([("src", "o1"), ("src/pay", "o3"), ("src/pay", "o2"), (None, "o9")], "prefix string, owner string")
    p = spark.createDataFrame([("src/pay/x",), ("src/payment",), ("doc",), (None,), ("src",)], "path string")
    assert {r["path"]: r["owner"] for r in R.prefix_owner(p, own).collect()} == {"src/pay/x": "o2", "src/payment": "o1", "src": "o1"}


def test_votes(spark):
    rows = [("x", 1, "b"), ("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c"), ("y", 1, "a"), ("y", 2, "a"), ("z", 1, "a"), ("w", 1, None), ("x", 2, "b")]
    got = {r["i"]: (r["reading"], r["votes"], r["contested"]) for r in R.vote(spark.createDataFrame(rows, "i string, r int, l string"), "i", "r", "l").collect()}
    assert got == {"x": ("b", 1, True), "y": ("a", 2, False), "z": ("a", 1, True)}


def test_signers_and_rotations(spark):
    df = spark.createDataFrame([(True, False, False, True, True), (True, True, True, True, True), (False, True, True, True, True), (True, None, True, None, None), (True, False, False, False, True), (True, None, None, None, None)], "v boolean, r boolean, s boolean, o boolean, k boolean")
    assert [r[0] for r in df.select(R.signer_outcome(*map(F.col, "vrsok"))).collect()] == ["verified", "revoked", "signature-invalid", "verified", "wrong-scope", "unverified"]
    assert R.rotate({"a": "k1", "b": "z"}, [(2, "k2", "k3"), (1, "k1", "k2"), (3, "k1", "k9")]) == {"a": "k3", "b": "z"}
    rv, rg = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "key string, cursor int"), spark.createDataFrame([("a", 6), ("b", 4)], "key string, cursor int")
    assert {r["key"] for r in R.lifted(rv, rg).collect()} == {"b", "c"}
