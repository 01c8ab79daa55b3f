"""Subject areas of documents, by curated weighted terms in a multi-pattern automaton."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import subject_terms as T
from ledgerlark.session import cut

SUBJECTS = tuple(T.STRONG)
#: A subject belongs to a document if this share of its sentences treats it; a sentence treats it from this weight on.
SHARE, SENTENCE = 0.25, 0.9
#: Terms from this length on are also known with one letter missing or two swapped.
FUZZY_FROM = 7
#: A term in more than this share of all documents begins to lose weight.
COMMON = 0.2
#: No factor of rarity is below this, so that a term of weight 1, or two of a half, carries a sentence however common it is.
FLOOR = SENTENCE
#: Of several subjects that one sentence reaches, those by weak terms alone must have this weight, which two have unless one is
#: common; else they yield to the others.
CONTESTED = 2 * T.HALF

# Wrapping that sources put around sentences: short "label: value" lines, rules, ticket heads, shell lines, graph edges; leads of
# chat turns, quotes, lists and table cells.
_DROP = re.compile(r"[A-Za-z][\w-]{1,24}: (?!see |siehe |véase )[^\s.?!]+(?: [^\s.?!]+){0,3}|[-=*_]{3,}|\[[A-Z]+-\d+\] \w+|#\d+ \w+=\w+.*|[$%>] ?\w+ .*--.*|\$ .*|exit(?: code)? -?\d+|edge .*")
_LEAD = re.compile(r"^(?:@?[a-z][\w.]*-\d+: |@?\w+: (?=[A-ZÁÉÍÓÚÄÖÜ¿¡])|[*>+•-] |\w+ \w+ \| |\d+[.)] |#+ )")
_SENTENCE = re.compile(r"(?<=[.?!])[\"')]*\s+|(?<=[.?!]\w)\s+(?=[A-ZÁÉÍÓÚÄÖÜ¿¡])")
#: A cross-reference often ends without a full stop; a capital or the next subject after it begins a sentence of its own.
_SEE = re.compile(r"(: (?:see|siehe|véase) (?:[A-Z]{2,4} [a-z]+|[a-z][a-z-]*(?: [a-z][a-z-]*){0,2}?)) (?=[A-Z¿¡]|[a-z]+-[a-z]+ [a-z]+s )")


def sentences(text: str) -> list[str]:
    """The sentences of a document without the wrapping of its source."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("{"):
            try:
                x = json.loads(line)
                line = x["text"].strip() if isinstance(x.get("text"), str) else line
            except (ValueError, AttributeError):
                pass
        if _DROP.fullmatch(line) or not (line := _LEAD.sub("", line)) or _DROP.fullmatch(line):
            continue
        for part in (_SEE.sub(r"\1\n", line) if ": see " in line else line).splitlines():
            out += [s for s in _SENTENCE.split(part) if any(c.isalpha() for c in s)]
    return out


def _variants(term: str) -> set[str]:
    if len(term) < FUZZY_FROM:
        return {term}
    drop = {term[:i] + term[i + 1 :] for i in range(len(term))}
    swap = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    return {term} | {v for v in drop | swap if v == v.strip()}


@cache
def terms() -> list[tuple[str, str | None, float]]:
    """(term, subject or None for a figure of speech, weight)."""
    rows = [(t, s, w) for table, w in ((T.STRONG, 1.0), (T.WEAK, T.HALF), (T.VERBS, T.HALF)) for s, line in table.items() for t in line.split("|")]
    return rows + [(t, None, 0.0) for t in T.FIGURES.split("|")]


@cache
def automaton() -> ahocorasick.Automaton:
    """String -> (the terms it stands for, its length); a weak word can belong to several subjects."""
    known: dict[str, list[int]] = {}
    for i, (t, _, _) in enumerate(terms()):
        known.setdefault(t, []).append(i)
    a = ahocorasick.Automaton()
    for t, ids in known.items():
        for v in _variants(t):
            if v == t or (v not in known and not a.exists(v)):
                a.add_word(v, (ids, len(v)))
    a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return c.isalnum() or c == "-" or c == "_"


def matches(sentence: str) -> list[int]:
    """Terms in a sentence, as whole words, plural allowed; of overlapping ones the longest, then leftmost. A hyphen belongs
    to its word, so names of components hold no terms."""
    s = f" {sentence.lower()}  "
    found = []
    for end, (ids, n) in automaton().iter(s):
        b = end + 1
        c = s[b - n - 1]
        if c.isalnum() or c in "-_":
            continue
        c = s[b]
        if c.isalnum() or c in "-_":
            after = s[b + 1]
            if c != "s" or after.isalnum() or after in "-_":
                continue
        found.append((-n, b - n, b, ids))
    if len(found) < 2:
        return [i for f in found for i in f[3]]
    found.sort()
    kept: list[tuple[int, int, list[int]]] = []
    for _, a, b, ids in found:
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, ids))
    return [i for _, _, ids in kept for i in ids]


_EVIDENCE = "doc_id bigint, body bigint, n_sentences int, sentence array<int>, term array<int>"


def evidence(documents: DataFrame) -> DataFrame:
    """Per document: a hash of its text, how many sentences it has, and which terms stand in which. Whole texts; null and empty
    ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            n, where, what = [], [], []
            for text in batch.column(2).to_pylist():
                ss = sentences(text or "")
                w, t = [], []
                for k, s in enumerate(ss):
                    if (m := known.get(s)) is None:
                        m = matches(s)
                        if len(s) < 300:
                            known[s] = m
                    w += [k] * len(m)
                    t += m
                n.append(len(ss))
                where.append(w)
                what.append(t)
                if len(known) > 100_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.int32()))], names=["doc_id", "body", "n_sentences", "sentence", "term"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), "text").filter("doc_id is not null").mapInArrow(run, _EVIDENCE)


def rarity(ev: DataFrame) -> dict[int, float]:
    """The factor of each term by its document frequency in the whole corpus, equal texts counted once: 1 up to COMMON, then
    falling with its idf to FLOOR. The result has at most one entry per curated term."""
    texts = ev.select("body", F.array_distinct("term").alias("term")).groupBy("body").agg(F.first("term").alias("term"))
    counts = texts.select(F.explode(F.concat(F.array(F.lit(-1)), "term")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    df = {r["t"]: r["n"] for r in counts.collect()}
    n = df.pop(-1, 0)
    top = math.log(1 / COMMON)
    return {t: min(1.0, max(FLOOR, math.log((n + 1) / k) / top)) for t, k in df.items()}


def treated(found: list[int], weight: dict[int, tuple[str, float]]) -> list[str]:
    """The subjects that a sentence with these terms treats. weight: the subject of each term, and its weight."""
    got: dict[str, float] = {}
    for t in found:
        if t in weight:
            s, w = weight[t]
            got[s] = got.get(s, 0.0) + w
    on = [s for s, w in got.items() if w >= SENTENCE]
    if len(on) > 1:
        strong = {weight[t][0] for t in found if t in weight and terms()[t][2] > T.HALF}
        on = [s for s in on if s in strong or got[s] >= CONTESTED] or on
    return on


def subject_shares(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, subject, n_sentences, on_subject, share): share of the document's sentences that treat the subject.

    A sentence treats a subject if its terms, weighted by curation and rarity, reach SENTENCE; where several subjects do, weak
    terms that are common yield. Repeated doc_ids are judged row by row and come out once. Documents without text or terms have
    no rows; an empty table gives none.
    """
    ev = cut(evidence(documents))
    factor = rarity(ev)
    weight = {i: (s, w * factor.get(i, 1.0)) for i, (_, s, w) in enumerate(terms()) if s}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, n, where, what in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[int, list[int]] = {}
                for k, t in zip(where, what):
                    found.setdefault(k, []).append(t)
                on: dict[str, int] = {}
                for ts in found.values():
                    for s in treated(ts, weight):
                        on[s] = on.get(s, 0) + 1
                out += [(d, s, n, c, c / n) for s, c in on.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "subject", "n_sentences", "on_subject", "share"])

    return ev.drop("body").mapInArrow(run, "doc_id bigint, subject string, n_sentences int, on_subject int, share double")


def assign(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, subject): every subject that at least ``share`` of the document's sentences treat."""
    return subject_shares(documents).filter(F.col("share") >= share).select("doc_id", "subject").distinct()
