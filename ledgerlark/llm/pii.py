"""Personal details in free text: found by the character model, and replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.pii_model import KINDS, Model, encode, segments

MODEL_PATH = Path(__file__).with_name("pii_model.npz")
#: Segments whose result a task remembers, and texts that it decodes at once.
REMEMBER, AT_ONCE = 150_000, 4_000

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]++(?:\s*[@＠]\s*|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)[\w-]+(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[\w-]+)+", re.I)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Sir|Lady|Lord|Madam|Dame|Frau|Herrn?|Fräulein|Señor(?:a|ita)?|Sra?|Srta|Don|Doña|Doctora?|Profesora?|M|Mme|Monsieur|Madame)\.?\s+$", re.I)
_EDGE = " \t\r\n   \"'“”‘’„«»<>{}|;,:!?"


@cache
def model(path: str) -> Model:
    return Model.load(path)


def exact(text: str, kind: int, a: int, b: int) -> tuple[int, int] | None:
    """An exact check after the model: edges without quotes, brackets and closing punctuation; an email snaps to the address
    that it overlaps; numbers must have digits. None: it isn't a detail."""
    while a < b and (text[a] in _EDGE or (text[a] in "[(" and not (kind == 1 and ")" in text[a:b]))):
        a += 1
    while a < b and (text[b - 1] in _EDGE or text[b - 1] == "." or (text[b - 1] in ")]" and text[a:b].count("(") + text[a:b].count("[") < text[a:b].count(")") + text[a:b].count("]"))):
        b -= 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == 0:
        while a and not text[a - 1].isspace():  # the whole mailbox
            a -= 1
        for m in _EMAIL.finditer(text, a):
            if m.start() >= b:
                break
            if m.start() < b and a < m.end():
                start = m.start() + (7 if text[m.start() : m.start() + 7].lower() == "mailto:" else 0)
                return start, m.end()
        return None
    if kind in (1, 2):
        return (a, b) if digits >= 6 else None
    if kind == 3:
        return (a, b) if digits and any(c.isalpha() for c in s) else None
    # A name begins and ends with whole words, hyphens and apostrophes included.
    word = lambda i: 0 <= i < len(text) and (text[i].isalpha() or (text[i] in "-'’" and 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha()))
    while word(a - 1) and word(a):
        a -= 1
    while word(b) and word(b - 1):
        b += 1
    s = text[a:b]
    if not re.search(r"[\s.]", s) and not _TITLE.search(text, max(0, a - 12), a):  # one word alone is a name only after a title
        return None
    return (a, b) if sum(c.isalpha() for c in s) >= 2 and not digits else None


def find(texts: list[str], m: Model, known: dict[bytes, list]) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of each text, in order. ``known`` keeps the spans of segments by their classes."""
    todo: dict[bytes, object] = {}
    cut = []
    for t in texts:
        ids = encode(t)
        parts = []
        for a, b in segments(t):
            key = ids[a:b].tobytes()
            parts.append((a, key))
            if key not in known and key not in todo:
                todo[key] = ids[a:b]
        cut.append(parts)
    if todo:
        keys = list(todo)
        fresh = dict(zip(keys, m.decode([todo[k] for k in keys])))
    else:
        fresh = {}
    out = []
    for t, parts in zip(texts, cut):
        spans: list[tuple[int, int, int]] = []
        for at, key in parts:
            for kind, a, b in known[key] if key in known else fresh[key]:
                if (ab := exact(t, kind, a + at, b + at)) and (not spans or ab[0] >= spans[-1][2]):
                    spans.append((kind, *ab))
        out.append(spans)
    if len(known) > REMEMBER:
        known.clear()
    known.update(fresh)
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))


def spans(df: DataFrame, key: str, text: str, model_path: str = str(MODEL_PATH)) -> DataFrame:
    """One row per personal detail: key, pii_kind, start_char, end_char (code points from 0, end exclusive).

    Whole texts are read. Null and empty texts give no rows, a null key is kept as null, repeated rows give repeated spans,
    an empty table gives none; a text of any length is cut into segments and windows, so memory doesn't grow with its square.
    Only ``key`` and ``text`` are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model(model_path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = find(part.column(1).to_pylist(), m, known)
                rows = [(i, *s) for i, x in enumerate(found) for s in x]
                if rows:
                    i, k, a, b = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array([KINDS[x] for x in k]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["row_key", "pii_kind", "start_char", "end_char"])

    slim = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).filter("text is not null and text != ''")
    return slim.mapInArrow(run, "row_key string, pii_kind string, start_char int, end_char int")


def redact(df: DataFrame, text: str, out: str = "redacted", model_path: str = str(MODEL_PATH)) -> DataFrame:
    """``df`` with the column ``out``: the text with each detail replaced by [KIND], the rest unchanged. Null stays null, an
    empty text stays empty. A column ``out`` that exists already is replaced."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known = model(model_path), {}
        for s in batches:
            texts = [t if isinstance(t, str) else "" for t in s]
            res: list[str | None] = []
            for at in range(0, len(texts), AT_ONCE):
                for t, found in zip(texts[at : at + AT_ONCE], find(texts[at : at + AT_ONCE], m, known)):
                    for kind, a, b in reversed(found):
                        t = f"{t[:a]}[{KINDS[kind].upper()}]{t[b:]}"
                    res.append(t)
            yield pd.Series([r if isinstance(o, str) else None for r, o in zip(res, s)], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(text)))
