import random

from ledgerlark.operators import changefeed as C


def test_fold_is_commutative_and_keeps_deletions(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, 1, 2, 3, 4, 5, 6]), r.choice([C.SET, C.DELETE]), f"p{r.randrange(9)}") for _ in range(200)]
    schema = "key string, seq bigint, op int, payload string"
    want = {}
    for k, s, o, p in rows:
        if k is not None and s is not None:
            want[k] = max(want.get(k, (-1, -1, "")), (s, o, p))
    whole = {x["key"]: (x["seq"], x["op"], x["payload"]) for x in C.fold(spark.createDataFrame(rows, schema)).collect()}
    r.shuffle(rows)
    half = C.fold(spark.createDataFrame(rows[:90], schema))
    more = {x["key"]: (x["seq"], x["op"], x["payload"]) for x in C.fold(spark.createDataFrame(rows[60:], schema), half).collect()}
    assert whole == want == more
    late = C.fold(spark.createDataFrame([("a", 1, C.SET, "old")], schema), spark.createDataFrame([("a", 9, C.DELETE, "t")], schema))
    assert C.standing(late).count() == 0


def test_facts(spark):
    e = spark.createDataFrame([
        ("e1", "fact-event", "f1", "0010"), ("e1", "fact-event", "f1", "99"), ("e2", "fact-event", "f1", "20"), ("t1", "tombstone", None, "15"), ("e3", "fact-event", "f2", "5"), ("t2", "tombstone", None, "30"),
        ("t3", "tombstone", None, "40"), ("e4", "fact-event", "f3", "7"), ("t4", "tombstone", None, "50"), (None, "fact-event", "f9", "1"), ("e5", "fact-event", "f4", "bad"),
    ], "event_id string, message_type string, fact_id string, store_cursor string")
    t = spark.createDataFrame([("t1", "e1", True), ("t2", "e3", True), ("t2", "e3", True), ("t3", "nobody", True), ("t4", "e4", False), ("gone", "e2", True)], "tombstone_id string, target_event_id string, signer_authorized boolean")
    got = {tuple(x) for x in C.standing(C.fold(C.fact_changes(e, t))).collect()}
    assert got == {("f1", "e2"), ("f3", "e4")}
    assert C.fold(C.fact_changes(e.limit(0), t.limit(0))).count() == 0


E_SCHEMA = "event_id string, message_type string, fact_id string, store_cursor string"
T_SCHEMA = "tombstone_id string, target_event_id string, signer_authorized boolean"


def test_a_withdrawal_waits_for_its_target(spark):
    gone = spark.createDataFrame([("t1", "e1", True)], T_SCHEMA)
    first = C.feed_state(spark.createDataFrame([("t1", "tombstone", None, "5")], E_SCHEMA), gone)
    assert C.facts_after(first).count() == 0
    later = C.feed_state(spark.createDataFrame([("e1", "fact-event", "f1", "3"), ("e2", "fact-event", "f2", "4")], E_SCHEMA), gone.limit(0), first)
    assert [tuple(r) for r in C.facts_after(later).collect()] == [("f2", "e2")]
    again = C.feed_state(spark.createDataFrame([("e9", "fact-event", "f1", "6")], E_SCHEMA), gone, later)
    assert {tuple(r) for r in C.facts_after(again).collect()} == {("f1", "e9"), ("f2", "e2")}


def test_every_split_gives_the_same_facts(spark):
    r = random.Random(8)
    events = [(f"e{i}", "fact-event", f"f{r.randrange(12)}", str(r.randrange(200)).zfill(r.choice([1, 6]))) for i in range(60)] + [(f"t{i}", "tombstone", None, str(r.randrange(200))) for i in range(25)]
    events += [(e, m, f, str(r.randrange(200))) for e, m, f, _ in r.sample(events, 20)]
    gone = [(f"t{i}", f"e{r.randrange(60)}", r.random() < 0.8) for i in range(25)] + [("t1", "nobody", True), (None, "e1", True), ("t2", None, True)]
    fact, first = {}, {}
    for e, m, f, c in sorted(events, key=lambda x: (int(x[3]), x[2] or "")):
        if e not in first:
            first[e], fact[e] = int(c), f if m == "fact-event" else None
    changes = [(fact[e], first[e], C.SET, e) for e in first if fact[e]] + [(fact[x], first[t], C.DELETE, t) for t, x, ok in gone if ok and t in first and fact.get(x)]
    best = {}
    for k, *rest in changes:
        best[k] = max(best.get(k, [-1]), rest)
    want = {(k, v[2]) for k, v in best.items() if v[1] == C.SET}
    for seed in range(3):
        r = random.Random(seed)
        state = None
        for part in range(3):
            ev = [e for e in events if r.random() < 0.5 or part == 2]
            go = [g for g in gone if r.random() < 0.5 or part == 2]
            state = C.feed_state(spark.createDataFrame(ev, E_SCHEMA), spark.createDataFrame(go, T_SCHEMA), state)
        assert {tuple(x) for x in C.facts_after(state).collect()} == want


def test_very_large_cursors(spark):
    e = spark.createDataFrame([("e1", "fact-event", "f", "99999999999999999999"), ("e2", "fact-event", "f", " 00100000000000000000000 "), ("e3", "fact-event", "g", "1.5"), ("e4", "fact-event", "h", None)], E_SCHEMA)
    assert [tuple(x) for x in C.facts_after(C.feed_state(e, spark.createDataFrame([], T_SCHEMA))).collect()] == [("f", "e2")]
