import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from ledgerlark.llm import subject_terms as T
from ledgerlark.llm import subjects as S
from subject_sentences import NONE, SENTENCES


def on(sentence):
    got = {}
    for i in S.matches(sentence):
        _, s, w = S.terms()[i]
        if s:
            got[s] = got.get(s, 0) + w
    return {s for s, w in got.items() if w >= S.SENTENCE}


def brute(sentence):
    """All exact terms as whole words, without the automaton."""
    s, hits = sentence.lower(), []
    for i, (t, _, _) in enumerate(S.terms()):
        at = s.find(t)
        while at >= 0:
            a, b = at, at + len(t)
            plural = b < len(s) and s[b] == "s" and (b + 1 == len(s) or not S._inner(s[b + 1]))
            if not (a and S._inner(s[a - 1])) and (b == len(s) or not S._inner(s[b]) or plural):
                hits.append((-len(t), a, b, i))
            at = s.find(t, at + 1)
    kept = []
    for n, a, b, i in sorted(hits):
        if all(b <= x or y <= a or (a, b) == (x, y) for x, y, _ in kept):
            kept.append((a, b, i))
    return {i for _, _, i in kept}


def test_sentences_and_subjects():
    assert on("First the probate, then the tort.") == {"law"}
    assert on("That review was a marathon.") == set()
    assert on("First the marathon, then the podium.") == {"sport"}
    assert on("She returns half-time after the birth, starting Monday.") == {"people"}
    assert on("osprey-parser and token-broker share one cursor.") == set()
    assert on("Zum Thema Speicherleck wurde die Notiz ersetzt.") == {"software"}
    assert on("Rejected 8 times already: the kelogger.") == {"security"}
    assert on("Rejected 8 times already: the keylgoger.") == {"security"}
    assert on("The health check of the queue is green.") == set()


def test_automaton_equals_a_plain_search():
    texts = ["According to the owner the tax return outperforms every shareholder.", "Take that with a grain of salt.", "The salt and hash of the access tokens.", "A new branch: git branch, pull requests; api endpoint!", "courts loan loans cross-dock write-offs"]
    for t in texts:
        assert set(S.matches(t)) == brute(t), t


def test_wrapping_is_no_sentence():
    assert S.sentences('{"type":"message","role":"user","text":"See the thread above."}\n{"type":"message","role":"user","text":"Noted, thanks."}') == ["See the thread above.", "Noted, thanks."]
    assert S.sentences("adr: 378\nstatus: superseded\n\nThe loan is due. Noted.") == ["The loan is due.", "Noted."]
    assert S.sentences("$ kin recall --budget 9\n> parser: see linter\nexit 1") == ["parser: see linter"]
    assert S.sentences("#12 state=merged\n\ncompiler: see API endpoint See the thread above.\n\nTickets: QLM-1") == ["compiler: see API endpoint", "See the thread above."]
    assert S.sentences("") == [] and S.sentences("--- \n 12 .") == []


def test_long_lines_without_blanks_split_fast():
    began = time.process_time()
    for line in ("data: " + "x" * 60_000 + ".", "a" * 60_000, "key: " + "b-" * 30_000 + "!", "> " + "c:" * 30_000):
        S.sentences(line)
    assert time.process_time() - began < 2


def test_a_quarter_is_enough(spark):
    one, none = "The loan is late. ", "Noted, thanks. "
    rows = [(1, one + none * 3), (2, one + none * 4), (3, one * 2 + "The tort is old. " * 2 + none * 4), (4, None), (5, ""), (6, "x" * 200_000), (7, (one + none) * 4000), (1, one + none * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, subject int").repartition(3)
    assert {tuple(r) for r in S.assign(df).collect()} == {(1, "finance"), (3, "finance"), (3, "law"), (7, "finance")}
    assert S.assign(df).count() == 4 and S.assign(df.limit(0)).count() == 0


def test_copies_of_a_third_of_all_rows_keep_their_subjects(spark):
    copied, other = "The loan is late. Noted, thanks.", "First the marathon, then the podium. Noted, thanks."
    rows = [(i, copied if i < 40 else other if i < 60 else "Noted, thanks.") for i in range(119)] + [(119, "A loan again.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {tuple(r) for r in S.assign(df).collect()} == {(i, "finance") for i in (*range(40), 119)} | {(i, "sport") for i in range(40, 60)}
    verb = T.VERBS["finance"].split("|")[:2]
    assert T.HALF * S.FLOOR * len(verb) >= S.SENTENCE


def test_rarity_is_one_formula_at_every_size(spark):
    for n in (4, 100):
        ev = S.evidence(spark.createDataFrame([(i, "The loan is late.") for i in range(n)], "doc_id bigint, text string"))
        assert set(S.rarity(ev).values()) == {S.FLOOR}, n


def test_common_weak_terms_yield_where_subjects_compete(spark):
    """Half-time and steward are weak terms of people, slalom is a strong one of sport. Copies of a text count once."""
    both, weak, other = "The half-time and the slalom surprised the steward.", "The half-time surprised the steward.", "The steward nodded."
    for others, want in ((range(10, 20), {"sport"}), ([], {"sport", "people"})):
        rows = [(1, both), (2, weak), *((i, f"{other} Note {i}.") for i in others), *((i, f"Noted, thanks, {i}.") for i in range(20, 35)), *((i, both) for i in range(40, 60))]
        got = {tuple(r) for r in S.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
        assert got == {(i, s) for i in (1, *range(40, 60)) for s in want} | {(2, "people")}


def test_every_subject_has_terms():
    assert set(T.STRONG) == set(T.WEAK) == set(T.VERBS) and all(len(v.split("|")) >= 100 for v in T.STRONG.values())


def test_held_out_raters(spark):
    """Against the raters' sample, whose errors are their own: nine of ten agree."""
    from pathlib import Path

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        return
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_labels.parquet")
    got = {tuple(r) for r in S.assign(docs.join(lab, "doc_id", "left_semi")).collect()}
    want = {(r["doc_id"], r["subject"].strip().lower()) for r in lab.collect()}
    assert len(got & want) >= 0.9 * max(len(got), len(want))


def test_sentences_written_by_hand():
    lines = [(k, x) for k, v in SENTENCES.items() for x in v.splitlines()]
    found = [on(x) for _, x in lines]
    assert len(lines) == 200
    assert sum(k in got for (k, _), got in zip(lines, found)) >= 0.9 * len(lines)
    assert sum(len(got - {k}) for (k, _), got in zip(lines, found)) <= 0.05 * len(lines)
    assert sum(bool(on(x)) for x in NONE.splitlines()) <= 1
