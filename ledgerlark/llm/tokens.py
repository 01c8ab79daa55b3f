"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("LEDGERLARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the text is split before merging, the vocabulary's own pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is encoded in pieces of this many characters, cut before a space; merges never cross that place.
PIECE = 20_000


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that hold the same tokens as the whole: cut before a space between word characters."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and not (text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count(text: str | None, path: str = TOKENIZER) -> int:
    return sum(len(encoding(path).encode_ordinary(p)) for p in pieces(text)) if text else 0


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and n_tokens. Null and empty texts have 0 tokens. The text itself isn't carried on."""
    slim = df.select(*keep, F.col(text).alias("_text"))
    schema = slim.drop("_text").withColumn("n_tokens", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*b.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(run, schema)
