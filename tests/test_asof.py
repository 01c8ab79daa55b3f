import datetime as dt
import random

from ledgerlark.operators import asof

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def brute(events, revs):
    plain = lambda k: None if k is None else k.strip().lower().split(":")[-1].strip()
    out = {}
    for fid, s, sc, t in events:
        ok = [(e, i) for i, k, e, p, rs in revs if None not in (s, t, e, p, k) and plain(k) == plain(s) and e <= t and p <= t and (rs is None or rs == sc)]
        out[fid] = max(ok)[1] if ok else None
    return out


def test_both_ways_equal_brute_force(spark):
    r = random.Random(7)
    day = lambda: T0 + dt.timedelta(hours=r.randrange(24 * 40))
    revs = [(i, r.choice(["ed25519:AA", " bb", "cc", "Aa", None]), day(), day() if r.random() > 0.05 else None, r.choice([None, "s1", "s2"])) for i in range(80)]
    revs += [(1000 + i, *x[1:]) for i, x in enumerate(revs[:20])]
    events = [(i, r.choice(["aa", "AA ", "ed25519:bb", "zz", "hot", None]), r.choice(["s1", "s2", None]), day() if r.random() > 0.03 else None) for i in range(500)]
    e = spark.createDataFrame([(*x, 5, 6) for x in events], "feed_row_id bigint, signer string, authority_scope string, recorded_at timestamp, value int, known_at int")
    v = spark.createDataFrame(revs, "revocation_id bigint, revoked_key string, effective_at timestamp, published_at timestamp, revoked_scope string")
    want = brute(events, revs)
    for rows in (10_000, 0):
        got = asof.revocations_in_force(e, v, broadcast_rows=rows).collect()
        assert len(got) == 500 and {x[0]: x[1] for x in got} == want
    none = asof.revocations_in_force(e, v.limit(0)).collect()
    assert len(none) == 500 and all(x[1] is None for x in none)
    assert asof.revocations_in_force(e.limit(0), v, broadcast_rows=0).count() == 0
