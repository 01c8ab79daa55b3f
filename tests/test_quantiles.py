import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.operators import quantiles as Q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=300), min_size=1, max_size=6), st.sampled_from([0.5, 0.1, 0.02]))
def test_merge_keeps_the_bound(parts, eps):
    per = [Q.Summary.of_sorted(np.sort(np.array(p, float))).compress(eps / 2) for p in parts]
    s = Q.Summary.merge(per).compress(eps / 2)
    whole = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert s.n == len(whole)
    if not s.n:
        return
    for pct in (1, 50, 95, 99, 100):
        v, miss = s.at(pct)
        r = max(1, -(-pct * s.n // 100))
        lo, hi = np.searchsorted(whole, v, "left") + 1, np.searchsorted(whole, v, "right")
        true = 0 if lo <= r <= hi else min(abs(lo - r), abs(hi - r))
        assert true <= miss <= eps * s.n + 1


def test_pack_round_trip():
    s = Q.Summary.of_sorted(np.arange(10.0))
    t = Q.Summary.unpack(s.pack())
    assert t.n == 10 and (t.value == s.value).all() and (t.rmax == s.rmax).all()


def test_groups_nulls_ties_and_clashing_names(spark):
    rows = [("a", "x", float(i), 1) for i in range(2000)] + [("b", "x", 7.0, 2)] * 50 + [(None, "y", 1.0, 3), ("c", "z", None, 4), ("c", "z", float("nan"), 5)]
    df = spark.createDataFrame(rows, "k0 string, part string, v double, summary int").repartition(7)
    out = {(r["k0"], r["part"], r["pct"]): r for r in Q.percentiles(Q.summarize(df, ["k0", "part"], "v")).collect()}
    assert {k[:2] for k in out} == {("a", "x"), ("b", "x"), (None, "y")}
    assert abs(out["a", "x", 50]["value"] - 999) <= 10 and out["a", "x", 50]["n"] == 2000
    assert out["b", "x", 99]["value"] == 7.0
    assert Q.summarize(df.limit(0), ["k0"], "v").count() == 0


def test_days_merge_to_the_whole(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(1000, 6000)
    df = spark.createDataFrame([("a", str(i % 6), float(x)) for i, x in enumerate(v)], "k string, day string, v double")
    whole = Q.percentiles(Q.merge_summaries(Q.summarize(df, ["k", "day"], "v"), ["k"])).collect()
    v.sort()
    for r in whole:
        at = np.searchsorted(v, r["value"])
        assert abs(at + 1 - -(-r["pct"] * 6000 // 100)) <= r["rank_error"] <= 0.005 * 6000 + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=1, max_size=20), min_size=2, max_size=5))
def test_merge_of_exact_summaries_is_the_sorted_union(parts):
    s = Q.Summary.merge([Q.Summary.of_sorted(np.sort(np.array(p, float))) for p in parts])
    whole = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert (s.value == whole).all() and (s.rmin == np.arange(1, len(whole) + 1)).all() and (s.rmax == s.rmin).all()


def test_a_deep_tree_keeps_the_bound():
    rng, eps, levels, seen = np.random.default_rng(4), 0.02, [[]], []
    for _ in range(Q.FAN_IN * Q.FAN_IN + 40):
        v = np.sort(rng.lognormal(3, 2, 900))
        seen.append(v)
        Q._merge_up(levels, Q.Summary.of_sorted(v).settle(eps), eps)
    s = Q.Summary.merge([x for lv in levels for x in lv]).settle(eps)
    whole = np.sort(np.concatenate(seen))
    assert s.level >= 3 and s.n == len(whole) and s.rank_error() <= eps * s.n
    for pct in (1, 50, 95, 99):
        v, miss = s.at(pct)
        assert abs(np.searchsorted(whole, v) + 1 - -(-pct * s.n // 100)) <= miss <= eps * s.n


def test_many_parts_merge_in_rounds(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(str(i % 3), float(x)) for i, x in enumerate(rng.normal(size=9000))], "k string, v double").repartition(70)
    out = {(r["k"], r["pct"]): r for r in Q.percentiles(Q.summarize(df, ["k"], "v")).collect()}
    assert len(out) == 9 and all(r["n"] == 3000 and r["rank_error"] <= Q.EPS * 3000 + 1 for r in out.values())
