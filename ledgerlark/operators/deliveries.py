"""Messages delivered more than once: exactly one copy of each is kept.

A persistent index holds, by hash prefix, sorted arrays of the identifiers seen, each with the order key of the copy kept.
An incoming batch is deduplicated where its rows lie, then by prefix; its identifiers are looked up by binary search in the
prefix's immutable runs, and what is novel, or takes over, becomes a further run. Runs are merged when they grow in number,
small ones first. A copy that arrives in a later batch but was delivered earlier takes over, and the copy kept so far comes
out as the repeated one.

An identifier is stored as its SHA-256, at every length, and its prefix is the digest's first bits. So arrays have a fixed
width, prefixes are even, and a prefix splits in two by cutting its arrays in the middle.

Files of an index, all written once::

    prefix=<p>/<generation>-<token>.npz    a run: ids, at, delivery
    prefix=<p>/<generation>-<token>.json   the prefix's runs as of that generation, oldest first
    repeated/<generation>-<token>/         the deliveries that a batch turned into repeated ones
    commits/<generation>-<token>.json      written last, by the driver

A task reads the newest list of its prefix among committed generations, so prefixes that a batch doesn't touch need no copy,
a task that runs again writes the same, and a batch that failed half way leaves nothing that anyone reads.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import shared_path

#: Identifiers that a prefix should hold; a worker holds one prefix at a time, 48 bytes an identifier.
PREFIX_IDS = 2_000_000
LEAST_PREFIXES = 64
MAX_RUNS = 6
BATCH_ROWS = 50_000
LOCAL_ROWS = 200_000
#: Batches that ``repeated_deliveries`` admits one after the other.
BATCHES = 5
ID = np.dtype("S32")


def prefixes_for(rows: int) -> int:
    """A power of two."""
    n = LEAST_PREFIXES
    while n * PREFIX_IDS < rows:
        n *= 2
    return n


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _first_copies(ids: np.ndarray, at: np.ndarray, delivery: np.ndarray) -> tuple[Run, np.ndarray]:
    """The best copy of each identifier, sorted, and the other deliveries. The very same delivery again isn't another copy."""
    order = np.lexsort((delivery, at, ids))
    ids, at, delivery = ids[order], at[order], delivery[order]
    first, same = np.ones(len(ids), bool), np.zeros(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    same[1:] = ~first[1:] & (delivery[1:] == delivery[:-1])
    return (ids[first], at[first], delivery[first]), delivery[~first & ~same]


def merge_runs(runs: list[Run]) -> Run:
    """One run of many, given oldest first: of an identifier the newest entry stands, which is also the best copy."""
    ids, at, delivery = (np.concatenate(x[::-1]) for x in zip(*runs))
    order = np.argsort(ids, kind="stable")
    keep = np.ones(len(order), bool)
    keep[1:] = ids[order][1:] != ids[order][:-1]
    order = order[keep]
    return ids[order], at[order], delivery[order]


class Runs:
    """The index of one prefix: immutable sorted runs, oldest first."""

    def __init__(self, runs: list[Run] | None = None) -> None:
        self.runs: list[Run] = list(runs or [])

    def admit(self, ids: np.ndarray, at: np.ndarray, delivery: np.ndarray) -> np.ndarray:
        """Takes a batch in; returns the deliveries that turn out to be repeated."""
        (ids, at, delivery), losers = _first_copies(ids, at, delivery)
        repeated = [losers]
        add, open_ = np.ones(len(ids), bool), np.ones(len(ids), bool)
        for r_ids, r_at, r_delivery in reversed(self.runs):
            if not len(r_ids):
                continue
            pos = np.searchsorted(r_ids, ids).clip(max=len(r_ids) - 1)
            h = np.flatnonzero(open_ & (r_ids[pos] == ids))
            p = pos[h]
            better = (at[h] < r_at[p]) | ((at[h] == r_at[p]) & (delivery[h] < r_delivery[p]))
            other = delivery[h] != r_delivery[p]
            repeated += [delivery[h[~better & other]], r_delivery[p[better & other]]]
            add[h[~better]] = False
            open_[h] = False
        if add.any():
            self.runs.append((ids[add], at[add], delivery[add]))
        return np.concatenate(repeated)


def _dump(run: Run) -> bytes:
    b = io.BytesIO()
    np.savez(b, ids=run[0], at=run[1], delivery=run[2])
    return b.getvalue()


class _Prefix:
    """One prefix in the shared folder, as a task sees it."""

    def __init__(self, store: fs.FileSystem, root: str, prefix: int, committed: frozenset[str]):
        self.store, self.dir = store, f"{root}/prefix={prefix:06d}"
        found = store.get_file_info(fs.FileSelector(self.dir, allow_not_found=True))
        lists = [n for n in (i.base_name[:-5] for i in found if i.base_name.endswith(".json")) if n in committed]
        self.files: list[tuple[str, int]] = []
        if lists:
            with store.open_input_stream(f"{self.dir}/{max(lists)}.json") as f:
                self.files = [tuple(x) for x in json.loads(f.read())]
        self.runs = Runs([self._load(n) for n, _ in self.files])

    def _load(self, name: str) -> Run:
        with self.store.open_input_stream(f"{self.dir}/{name}") as f:
            z = np.load(io.BytesIO(f.read()))
        return z["ids"], z["at"], z["delivery"]

    def _write(self, name: str, data: bytes) -> None:
        """Whole files only; another attempt of the task writes the same bytes under the same name."""
        part = f"{self.dir}/{name}.{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(part) as f:
            f.write(data)
        try:
            self.store.move(part, f"{self.dir}/{name}")
        except OSError:  # stores that don't replace
            if self.store.get_file_info(f"{self.dir}/{name}").type != fs.FileType.File:
                raise
            self.store.delete_file(part)

    def save(self, name: str) -> None:
        """The batch's entries as one new run, merged with the last runs while these aren't at least twice as long."""
        new = self.runs.runs[len(self.files) :]
        if not new:
            return
        old, files = self.runs.runs[: len(self.files)], list(self.files)
        run = merge_runs(new)
        while files and (files[-1][1] < 2 * len(run[0]) or len(files) >= MAX_RUNS):
            run = merge_runs([old.pop(), run])
            files.pop()
        self.store.create_dir(self.dir, recursive=True)
        self._write(f"{name}.npz", _dump(run))
        self._write(f"{name}.json", json.dumps([*files, [f"{name}.npz", len(run[0])]]).encode())


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(t.column("message").to_pylist()), ID)
    return ids, t.column("at").to_numpy(), t.column("delivery").to_numpy()


_ROWS = "prefix int, message binary, at bigint, delivery bigint"
_ROW_FIELDS = [("prefix", pa.int32()), ("message", pa.binary()), ("at", pa.int64()), ("delivery", pa.int64())]


def _local(prefixes: int):
    """Deduplicates what a task holds at a time. Losers go on without a message, spread over all prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            (ids, at, delivery), losers = _first_copies(*_arrays(pa.Table.from_batches(held)))
            first = np.frombuffer(ids.tobytes(), ">u8")[::4]
            where = np.concatenate([(first >> np.uint64(64 - (prefixes.bit_length() - 1))).astype(np.int32), (losers % prefixes).astype(np.int32)])
            raw, n = ids.tobytes(), ID.itemsize
            message = [raw[i : i + n] for i in range(0, len(raw), n)] + [None] * len(losers)
            cols = [where, pa.array(message, pa.binary()), np.concatenate([at, np.zeros(len(losers), np.int64)]), np.concatenate([delivery, losers])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ROW_FIELDS)], names=[n for n, _ in _ROW_FIELDS])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= LOCAL_ROWS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _admit(index: str, name: str, committed: frozenset[str]):
    """Rows come sorted by prefix, so one prefix is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(index)
        cur: _Prefix | None = None
        at_prefix = None

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                t = pa.Table.from_batches([batch.slice(start, BATCH_ROWS)])
                prefix = t.column("prefix").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(prefix)]
                out = []
                for a, b in zip(cuts, cuts[1:]):
                    if prefix[a] != at_prefix:
                        if cur is not None:
                            cur.save(name)
                        at_prefix = int(prefix[a])
                        cur = _Prefix(store, root, at_prefix, committed)
                    part = t.slice(a, b - a)
                    lost = part.column("message").is_null().to_numpy()
                    out.append(part.column("delivery").to_numpy()[lost])
                    if not lost.all():
                        out.append(cur.runs.admit(*_arrays(part.filter(pa.array(~lost)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], names=["delivery"])
        if cur is not None:
            cur.save(name)

    return run


class DeliveryIndex:
    """An index in the shared folder. An existing ``path`` is opened as its last committed batch left it; the number of
    prefixes, a power of two, is fixed when it is made (``prefixes_for``)."""

    def __init__(self, spark: SparkSession, path: str | None = None, prefixes: int = LEAST_PREFIXES):
        self.spark, self.path = spark, path or shared_path(spark, "deliveries")
        self.store, self.root = fs.FileSystem.from_uri(self.path)
        made = f"{self.root}/prefixes.json"
        if self.store.get_file_info(made).type == fs.FileType.File:
            with self.store.open_input_stream(made) as f:
                prefixes = json.loads(f.read())
        else:
            if prefixes < 1 or prefixes & (prefixes - 1):
                raise ValueError("the number of prefixes must be a power of two")
            self.store.create_dir(f"{self.root}/commits", recursive=True)
            with self.store.open_output_stream(made) as f:
                f.write(json.dumps(prefixes).encode())
        self.prefixes = prefixes

    def commits(self) -> list[str]:
        """Committed generations, in order."""
        return sorted(i.base_name[:-5] for i in self.store.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True)) if i.base_name.endswith(".json"))

    def admit(self, batch: DataFrame) -> DataFrame:
        """Takes a batch in and returns its repeated deliveries (bigint ``delivery``), which are stored with it.

        ``batch``: message binary (32 bytes), at bigint, delivery bigint, none null. The batch is computed and committed before
        this returns; batches of one index are admitted one after the other.
        """
        done = self.commits()
        name = f"{(int(done[-1][:9]) + 1 if done else 0):09d}-{uuid.uuid4().hex[:12]}"
        slim = batch.select("message", "at", "delivery").mapInArrow(_local(self.prefixes), _ROWS)
        rows = slim.repartition("prefix").sortWithinPartitions("prefix")
        out = f"{self.path}/repeated/{name}"
        rows.mapInArrow(_admit(self.path, name, frozenset(done)), "delivery bigint").write.parquet(out)
        with self.store.open_output_stream(f"{self.root}/commits/{name}.json") as f:
            f.write(b"{}")
        return self.spark.read.schema("delivery bigint").parquet(out)

    def repeated(self) -> DataFrame:
        """The repeated deliveries of all committed batches; a delivery that was sent again after it lost can stand twice."""
        paths = [f"{self.path}/repeated/{n}" for n in self.commits()]
        return self.spark.read.schema("delivery bigint").parquet(*paths) if paths else self.spark.createDataFrame([], "delivery bigint")

    def vacuum(self) -> int:
        """Removes run files and lists that no later batch reads; returns how many. At most a few names a prefix are looked at."""
        done, gone = frozenset(self.commits()), 0
        for p in range(self.prefixes):
            cur = f"{self.root}/prefix={p:06d}"
            names = [i.base_name for i in self.store.get_file_info(fs.FileSelector(cur, allow_not_found=True))]
            lists = [n for n in names if n.endswith(".json") and n[:-5] in done]
            if not lists:
                continue
            with self.store.open_input_stream(f"{cur}/{max(lists)}") as f:
                live = {max(lists), *(n for n, _ in json.loads(f.read()))}
            for n in names:
                if n not in live:
                    self.store.delete_file(f"{cur}/{n}")
                    gone += 1
        return gone


def message_rows(observations: DataFrame) -> DataFrame:
    """Deliveries as index rows. A message is an observation_id without case and surrounding blanks; deliveries without an
    observation_id or delivery_id can't be told apart and are left out, thus all kept. A null delivered_at counts as latest."""
    message = F.unhex(F.sha2(F.lower(F.trim(F.col("observation_id"))).cast("binary"), 256))
    at = F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(1 << 62))
    return observations.filter("observation_id is not null and delivery_id is not null").select(message.alias("message"), at.alias("at"), F.col("delivery_id").alias("delivery"))


def repeated_deliveries(observations: DataFrame, batch: str | None = None, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """``delivery_id`` of every delivery but the one kept per message: earliest delivered_at, on ties smallest delivery_id.

    With ``batch``, an integer column that grows with arrival, the rows are admitted as up to ``batches`` batches of equal
    width in it, each against the stored index of those before; rows without it come first. The result doesn't depend on
    how batches are cut. Repeated rows count once, an empty table gives none, other columns are not read.
    """
    index = DeliveryIndex(observations.sparkSession, path, prefixes_for(observations.count()))
    low, high = observations.agg(F.min(batch), F.max(batch)).first() if batch else (None, None)
    if low is None:
        index.admit(message_rows(observations))
    else:
        width = max(1, -(-(high - low + 1) // batches))
        for start in range(low, high + 1, width):
            of = F.col(batch).between(start, start + width - 1)
            index.admit(message_rows(observations.filter(of | F.col(batch).isNull() if start == low else of)))
    return index.repeated().select(F.col("delivery").alias("delivery_id")).distinct()
