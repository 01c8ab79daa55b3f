"""Filling containers of fixed capacity with whole texts, by best fit under conflicts.

Texts are spread over shards by hash. A shard takes its texts from large to small and puts each into the fullest container
that still has room and no conflict. Open containers stand in order of free space; each carries bitmaps of the sources and
duplicate clusters in it. The search begins at the tightest container that has room and goes on to the next successor until
one is compatible. A text above the capacity is cut into full containers, and only its remainder is packed like a text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tokens import TOKENIZER, with_tokens

#: Sources of which one holds copies of the other's texts under other names; they don't share a container.
SOURCE_CONFLICTS = (("issue_tracker", "ticket_mirror"), ("document", "legacy_wiki"))
SHARD_ROWS = 8_000

_OUT = "container_kind string, capacity_tokens int, container_id string, doc_id bigint, part int, token_from bigint, token_until bigint, tokens int, source string"


class Bins:
    """Open containers of one shard, in order of free space."""

    def __init__(self, capacity: int, foes: dict[int, int]):
        self.capacity, self.foes = capacity, foes
        self.open: list[tuple[int, int]] = []  # (free, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, clusters: int) -> int:
        """The container that takes the item. source and clusters are bit positions and bitmaps; 0 bits never conflict."""
        foes = self.foes.get(source, 0)
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            free, b = self.open[at]
            if not (self.clusters[b] & clusters or self.sources[b] & foes):
                del self.open[at]
                break
            at += 1
        else:
            b, free = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= 1 << source
        self.clusters[b] |= clusters
        if free > size:
            insort(self.open, (free - size, b))
        return b


def pack_shard(kind: str, capacity: int, shard: int, rows: Iterable[tuple[int, int, str | None, str | None, str | None]], conflicts: tuple[tuple[str, str], ...] = SOURCE_CONFLICTS) -> list[tuple]:
    """Output rows of one shard; rows are (doc_id, tokens, source, cluster a, cluster b). Deterministic in any order of rows."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0], r[2] or "", r[3] or "", r[4] or ""))
    seen: dict[str, int] = {}
    for r in rows:
        for c in {c for c in r[3:5] if c is not None}:
            seen[c] = seen.get(c, 0) + 1
    bit = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}  # a cluster seen once can't conflict
    names = {s: i for i, s in enumerate(dict.fromkeys(r[2] for r in rows))}
    foes: dict[int, int] = {}
    for a, b in conflicts:
        if a in names and b in names:
            foes[names[a]] = foes.get(names[a], 0) | 1 << names[b]
            foes[names[b]] = foes.get(names[b], 0) | 1 << names[a]
    bins, full, out = Bins(capacity, foes), 0, []
    rest = []
    for doc, n, source, *cs in rows:
        mask = 0
        for c in cs:
            if c in bit:
                mask |= 1 << bit[c]
        whole = (n - 1) // capacity if n > capacity else 0
        for p in range(whole):
            out.append((kind, capacity, f"{kind}/{shard:06d}/f{full}", doc, p, p * capacity, (p + 1) * capacity, capacity, source))
            full += 1
        rest.append((n - whole * capacity, doc, whole, whole * capacity, source, mask))
    rest.sort(key=lambda r: -r[0])
    for n, doc, part, start, source, mask in rest:
        b = bins.put(n, names[source], mask)
        out.append((kind, capacity, f"{kind}/{shard:06d}/b{b}", doc, part, start, start + n, n, source))
    return out


def pack(documents: DataFrame, containers: DataFrame, conflicts: tuple[tuple[str, str], ...] = SOURCE_CONFLICTS, shard_rows: int = SHARD_ROWS, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document, container kind and part: the container it lies in and its tokens [token_from, token_until).

    Copies (same native_id, or the same text) never share a container, nor do conflicting sources. Documents without tokens
    (null or empty texts) take no room and have no rows; containers without a positive capacity are ignored; a null source is
    a source of its own; repeated rows are packed again. Shards are cut by hash of doc_id, so no source or group of copies
    gathers in one, and their number grows with the documents; each leaves at most a few containers partly filled.
    """
    shards = max(1, -(-documents.count() // shard_rows))
    cluster = F.when(F.col("native_id").isNotNull(), F.concat(F.lit("n"), "native_id")).alias("by_name")
    body = F.when(F.length("text") > 0, F.concat(F.lit("t"), F.hex(F.xxhash64("text")), F.lit("-"), F.hex(F.crc32(F.col("text").cast("binary"))))).alias("by_text")
    sized = with_tokens(documents.select("doc_id", "source", cluster, body, "text").filter("doc_id is not null"), "text", ["doc_id", "source", "by_name", "by_text"], tokenizer).filter("n_tokens > 0")
    kinds = containers.filter("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    # The kinds are a short list of settings; they go to every row.
    wanted = [(r["container_kind"], r["capacity_tokens"]) for r in kinds.orderBy("container_kind").collect()]
    each = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in wanted)) if wanted else F.expr("cast(array() as array<struct<container_kind string, capacity_tokens int>>)")
    rows = sized.select("*", F.explode(each).alias("c"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).select("*", "c.*").drop("c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = lambda s: [x if isinstance(x, str) else None for x in s]
        items = zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), none(pdf["source"]), none(pdf["by_name"]), none(pdf["by_text"]))
        out = pack_shard(pdf["container_kind"].iloc[0], int(pdf["capacity_tokens"].iloc[0]), int(pdf["shard"].iloc[0]), items, conflicts)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return rows.groupBy("container_kind", "shard").applyInPandas(run, _OUT)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, unused share and split texts of each kind."""
    bins = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("part") > 0).alias("splits"))
    return bins.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count("*") * F.col("capacity_tokens"))).alias("unused_share"), F.sum("splits").alias("split_parts"), F.max("tokens").alias("fullest"))


