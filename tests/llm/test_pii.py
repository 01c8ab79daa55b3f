import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlark.llm import pii
from ledgerlark.llm.pii_model import KINDS, Model, encode, loss_and_grad, segments, spans_of
from ledgerlark.llm.pii_train import Maker, evaluate
from pii_sentences import cases


def found(text):
    return [(KINDS[k], text[a:b]) for k, a, b in pii.find([text], pii.model(str(pii.MODEL_PATH)), {})[0]]


CASES = {
    "Ms O'Lumbwold owns token-broker; Mr van Kolmaczky owns the rest.": [("person_name", "O'Lumbwold"), ("person_name", "van Kolmaczky")],
    "Mr Lock and Ms Cache are the nicknames of the two cursor-gate workers.": [],
    "Signed-off-by: Wilhelmina Lumbánez <tressimarsh_kwame [at] kolm [dot] invalid>": [("person_name", "Wilhelmina Lumbánez"), ("email", "tressimarsh_kwame [at] kolm [dot] invalid")],
    "Clone via git@forge.example:harbor/cursor-gate.git and pin knotpack@5.39.5.": [],
    "Shard 916-59-3787 was rebuilt by mosaic-store for merged branches only.": [],
    "Passport 932-39-8951 was pasted into the cursor-gate fixture on every ingest.": [("national_id", "932-39-8951")],
    "Call (555) 555 0143 if mosaic-store stalls when the ledger is cold.": [("phone", "(555) 555 0143")],
    "SMS sent to +49 30 23125 855 (ext. 12) at 11:38, none to 001108.": [("phone", "+49 30 23125 855")],
    "Visit by Grace M. Brackümler at 8 Cindergate Crescent\nQuillmouth\nQX21 1DQ on 2025-01-17; gate code QLM-5455.": [("person_name", "Grace M. Brackümler"), ("street_address", "8 Cindergate Crescent\nQuillmouth\nQX21 1DQ")],
    "Rule: mark will hope for a fix in April or summer; dean of scope is quarry-sync.": [],
    "I asked Zofia Pellquist, they said osprey-parser now rewrites stale manifests.": [("person_name", "Zofia Pellquist")],
    "anne-lise de la pellümler and Siobhán O'Marwold disagree whether cursor-gate batches empty records.": [("person_name", "anne-lise de la pellümler"), ("person_name", "Siobhán O'Marwold")],
    "https://forge.example/u?mail=rose-dra@post.ömbra.example&ticket=3227": [("email", "rose-dra@post.ömbra.example")],
}


def test_details_and_traps():
    wrong = [(text, found(text)) for text, want in CASES.items() if found(text) != want]
    assert len(wrong) <= 2, wrong


def test_texts_written_by_hand():
    hit = got = want = 0
    for text, spans in cases():
        f = set(pii.find([text], pii.model(str(pii.MODEL_PATH)), {})[0])
        hit, got, want = hit + len(f & spans), got + len(f), want + len(spans)
    assert hit >= 0.9 * want and hit >= 0.9 * got, (hit, got, want)


def test_addresses_are_not_cut():
    for text in ("Ship to 12 Main St.\nSpringfield QX21 1DQ", "9 Hill Rd.\nYork", "5 Elm Blvd.\nDover"):
        assert segments(text) == [(0, len(text))]


def test_held_out_accuracy():
    got = evaluate(pii.model(str(pii.MODEL_PATH)), 500, 991)
    assert all(p >= 0.93 and r >= 0.93 for p, r in got.values()), got


def test_surroundings_and_length_change_nothing():
    text = "I asked Zofia Pellquist, they said osprey-parser now rewrites stale manifests."
    pad = "The shard-reader batches duplicate deliveries on every ingest. "
    assert found(pad * 400 + text + " " + pad * 400) == [("person_name", "Zofia Pellquist")]
    assert found("x" * 60_000) == [] and found(" \n \t") == []


def test_windows_of_a_long_segment_agree_with_one_pass():
    text = "; ".join(["my number is 020 7946 0340 and I live at 20 Ninth Ferry Row, Istermere QX15 3FP so send the token there"] * 6)
    assert len(segments(text)) == 1
    assert [k for k, _ in found(text)] == ["phone", "street_address"] * 6


def test_code_points_and_segments_cover_the_text():
    t = "😬 Ask Hana Vandwold. Then  Rückfragen an S. van Tressiquist, Tel. +1 (555) 555-0139."
    assert len(encode(t)) == len(t)
    assert all(t[a:b].strip() for a, b in segments(t))
    assert ("person_name", "S. van Tressiquist") in found(t)


def test_gradient():
    m, b = Model.new(5, 0), Maker(4).batch(3)
    b = (b[0][:12], b[1][:12], np.minimum(b[2], 12))
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = loss_and_grad(p, *b)
    for k, i in (("uf", (1, 2)), ("ub", (0, 3)), ("o", (1, 1)), ("tr", (0, 1)), ("st", (0,)), ("bf", (7,))):
        up, down = ({a: v.copy() for a, v in p.items()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        assert abs((loss_and_grad(up, *b)[0] - loss_and_grad(down, *b)[0]) / 2e-3 - g[k][i]) < 1e-5


def test_viterbi_is_the_best_path():
    m, rng = Model.new(4, 1), np.random.default_rng(0)
    m.p["tr"] = rng.normal(size=m.p["tr"].shape).astype(np.float32)
    e = rng.normal(size=(3, 11)).astype(np.float32)
    score = lambda y: m.p["st"][y[0]] + sum(e[t, y[t]] for t in range(3)) + sum(m.p["tr"][y[t], y[t + 1]] for t in range(2))
    best = max(((a, b, c) for a in range(11) for b in range(11) for c in range(11)), key=score)
    assert tuple(m.viterbi(e)) == best and all(tuple(x) == best for x in m.viterbi_batch([e, e]))
    assert spans_of(np.array([0, 1, 2, 1, 0, 4])) == [(0, 1, 3), (0, 3, 4), (1, 5, 6)]


def test_operator_on_odd_rows(spark):
    rows = [(1, "Ask Priya Dravholm.", "a"), (1, "Ask Priya Dravholm.", "b"), (2, None, "c"), (3, "", "d"), (None, "Call 020 7946 0322 if shard-reader stalls at shutdown.", "e")]
    df = spark.createDataFrame(rows, "id bigint, text string, pii_kind string").repartition(3)
    got = sorted(map(tuple, pii.spans(df, "id", "text").collect()), key=str)
    assert [g[1] for g in got] == ["person_name", "person_name", "phone"]
    red = {(r["id"], r["pii_kind"]): r["redacted"] for r in pii.redact(df, "text").collect()}
    assert red[1, "a"] == "Ask [PERSON_NAME]." and red[2, "c"] is None and red[3, "d"] == "" and red[None, "e"].startswith("Call [PHONE] if")
    assert pii.spans(df.limit(0), "id", "text").count() == 0


def test_redaction_leaves_the_rest():
    m = Maker(77)
    for _ in range(100):
        t, _ = m.text()
        out, at = "", 0
        for k, a, b in pii.find([t], pii.model(str(pii.MODEL_PATH)), {})[0]:
            assert a >= at
            out += t[at:a]
            at = b
        assert len(out + t[at:]) <= len(t)


def test_both_ways_of_running_agree():
    m, other = Model.load(pii.MODEL_PATH), Model.load(pii.MODEL_PATH)
    other.cells = {"f": None, "b": None}
    windows = [encode(t) for t, _ in cases()]
    assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(m.emissions(windows), other.emissions(windows)))
