"""Content-chosen anchors: which parts of a corpus can hold a passage that occurs elsewhere.

Every run of ``span`` symbols holds at least one anchor, a k-gram whose hash is
lowest among its neighbours, and equal runs hold equal anchors at equal places.
So a run can recur only around anchors that recur.  Documents are written once,
dealt to cells, in buckets that later passes read where they lie; cells exchange
nothing but hashes and notes:
  1. each cell sends its distinct anchor hashes to the hash's owner;
  2. owners answer which hashes came from several cells;
  3. cells look closer only around anchors found in several documents.
Copies of whole texts are found beforehand by digest and take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, flat, hot_join, parts, tidy
from .words import mix

#: Text bytes of a cell, and the most buckets of a table.
CELL, MOST_BUCKETS = 8 << 20, 100_000
LAST = (1 << 63) - 1
LOW = np.uint64((1 << 48) - 1)


class Cells:
    """Documents of a table dealt to cells by row, with markers of copies of whole texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shortest: int, work: Work, columns: tuple[str, ...] = ()):
        text = F.coalesce(F.col(text_col), F.lit(""))
        size = F.octet_length(text).cast("long")
        self.work, self.columns = work, columns
        self.bytes = docs.agg(F.sum(size)).first()[0] or 0
        self.cells = max(1, -(-self.bytes // CELL))
        self.buckets = min(MOST_BUCKETS, max(parts(work.spark), self.cells))
        self.owner_bits = min(16, max(4, int(self.bytes // CELL).bit_length()))
        uid = F.monotonically_increasing_id()
        rows = docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), uid.alias("uid"), F.pmod(F.xxhash64(F.lit(8), uid), F.lit(self.cells)).cast("int").alias("q"), text.alias("text"),
            size.alias("n"), F.xxhash64(F.lit(6), text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns],
        )
        self.docs = work.bucketed(rows, "cells", "q", self.buckets)
        keys = self.docs.where(F.col("n") >= shortest).select("q", "id", "uid", "n", "h1", "h2")
        first = work.save(keys.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1"), "first")
        copies = hot_join(keys, first, ["h1", "h2", "n"], "c").where("id > first")
        self.copies = work.save(copies.select("q", F.lit(0).alias("kind"), "uid", F.lit(None).cast("binary").alias("blob")), "copies")

    def each(self, f, schema: str, *notes: DataFrame, payload: bool = False) -> DataFrame:
        """Batches that ``f(cell, documents)`` yields for every cell.

        ``notes`` (q, kind, blob) and markers are dealt to the cells; documents
        (id, uid, text, and their other columns with ``payload``) stay where they are.
        """
        columns = ["q", "id", "uid", "text", *([f"_{c}" for c in self.columns] if payload else [])]
        all_ = self.copies
        for n in notes:
            all_ = all_.unionByName(n.select("q", "kind", F.lit(None).cast("long").alias("uid"), "blob"))
        kind = pa.schema([])

        def run(key, docs, told):
            nonlocal kind
            batches = list(f(Cell(key[0].as_py(), told), docs.drop_columns("q"))) if docs.num_rows else []
            tidy()
            if batches:
                kind = batches[0].schema
            return pa.Table.from_batches(batches, kind if batches else _schema(schema))

        return self.docs.select(*columns).groupBy("q").cogroup(all_.repartition(self.buckets, "q").groupBy("q")).applyInArrow(run, schema)


def _schema(text: str) -> pa.Schema:
    """The Arrow schema of columns of simple types."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in text.split(", ")])


def pieces(docs: pa.Table, most: int = 1 << 19):
    """Record batches of (id, uid, text, ...) that hold about ``most`` text bytes, or one row."""
    for batch in docs.to_batches():
        if batch.num_rows:
            _, at = flat(batch.column(2))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
                yield batch.slice(i, j - i)
                i = j


class Cell:
    """What a task holds of one cell: markers of copies and notes."""

    def __init__(self, q: int, told: pa.Table):
        self.q, self.told = q, told
        kind = told.column("kind").to_numpy()
        self.kind = kind
        self.copies = set(told.filter(pa.array(kind == 0)).column("uid").to_pylist()) if (kind == 0).any() else set()

    def fresh(self, docs: pa.Table) -> pa.Table:
        """Without the copies."""
        if not self.copies:
            return docs
        return docs.filter(pa.array([u not in self.copies for u in docs.column(1).to_pylist()]))

    def blobs(self, kind: int, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(self.told.filter(pa.array(self.kind == kind)).column("blob").to_pylist()), dtype)


def slide(f, a: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` neighbours."""
    p = 1
    while 2 * p <= width:
        a = f(a[:-p], a[p:])
        p *= 2
    return f(a[: len(a) - (width - p)], a[width - p :]) if p < width else a


def kgrams(symbols: np.ndarray, k: int) -> np.ndarray:
    """56-bit and more hashes of every k neighbours; symbols are scrambled 64-bit numbers."""
    out, have, part, size = None, 0, symbols, 1
    while True:
        if k & size:
            out = part[: len(symbols) - k + 1] if out is None else out[: len(symbols) - k + 1] * np.uint64(0x9E3779B97F4A7C15 ^ size * 2) + part[have : have + len(symbols) - k + 1]
            have += size
        if have == k:
            return mix(out)
        part = part[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + part[size:]
        size *= 2


def anchors(symbols: np.ndarray, at: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all runs of ``span`` symbols within one document; ``at`` bounds documents."""
    n, w = len(symbols), span - k + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.maximum(kgrams(symbols, k), np.uint64(1))
    low = slide(np.minimum, h, w)  # for each of the n - span + 1 runs
    end = np.repeat(at[1:], np.diff(at))
    start = np.arange(len(low))
    low[start + span > end[: len(low)]] = 0  # runs over a document's end
    pad = np.zeros(w - 1, np.uint64)
    reach = slide(np.maximum, np.concatenate([pad, low, pad]), w)
    pos = np.flatnonzero(reach == h)
    return pos, mix(h[pos])  # minima crowd at low values; owners want them spread


def owner_hash(h: np.ndarray, bits: int) -> np.ndarray:
    """The part of a hash that travels: its owner's bits over 48 others."""
    return h >> np.uint64(16 - bits)


def shrink(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def grow(blob: bytes, owner: int) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel() | (np.uint64(owner) << np.uint64(48))


def shared_here(hashes: list[np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """Hashes that occur in two documents of a cell."""
    h, d = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first[np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)]] if len(h) else h


def recurring(cells: Cells, anchors_of, work: Work) -> DataFrame:
    """Notes (q, kind 1, blob): the anchor hashes of each cell that other cells hold too.

    ``anchors_of(raw, offsets)`` gives (document, position, hash) of a slice's anchors.
    """
    bits = cells.owner_bits

    def send(cell, docs):
        held = [np.unique(owner_hash(anchors_of(*flat(b.column(2)))[2], bits)) for b in pieces(cell.fresh(docs))]
        if held:
            h = np.unique(np.concatenate(held))
            owner = (h >> np.uint64(48)).astype(np.int64)
            cut = np.searchsorted(owner, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), cell.q, np.int32)), pa.array([shrink(h[cut[i] : cut[i + 1]]) for i in full.tolist()], pa.binary())],
                names=["owner", "q", "blob"],
            )

    sent = cells.each(send, "owner int, q int, blob binary")

    def answer(batches):
        def out(owner, qs, blobs):
            h = np.concatenate([grow(b, owner) for b in blobs])
            q = np.repeat(np.array(qs, np.int32), [len(b) // 6 for b in blobs])
            order = np.argsort(h, kind="stable")
            h, q = h[order], q[order]
            same = h[1:] == h[:-1]
            hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            h, q = h[hit], q[hit]
            order = np.argsort(q, kind="stable")
            h, q = h[order], q[order]
            full, first = np.unique(q, return_index=True)
            ends = [*first[1:].tolist(), len(q)]
            if len(full):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.ones(len(full), np.int32)), pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())], names=["q", "kind", "blob"]
                )

        last, qs, blobs = None, [], []
        for b in batches:
            for owner, q, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if owner != last and blobs:
                    yield from out(last, qs, blobs)
                    qs, blobs = [], []
                    tidy()
                last = owner
                qs.append(q)
                blobs.append(blob)
        if blobs:
            yield from out(last, qs, blobs)

    owned = sent.repartition("owner").sortWithinPartitions("owner")
    return work.save(owned.mapInArrow(answer, "q int, kind int, blob binary"), "recurring")


#: Records of one anchor beyond which its strings are classified one by one, by Spark, and record bytes a task gathers before it looks for such anchors.
HOT, GATHER = 200_000, 96 << 20
WINDOW = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("id", "<i8"), ("uid", "<i8"), ("pos", "<i8"), ("stride", "<i4"), ("count", "<i4"), ("q", "<i4"), ("o", "<i4")])


def gather(batches, dtype: np.dtype, key: str):
    """(is_hot, records) from a stream of (part, blob) sorted by part.

    A part comes as one array, except for anchors with more than ``HOT`` records:
    theirs are passed on as they are read, so that a task holds ``GATHER`` bytes or
    so even if one anchor has a third of all records.
    """
    last, held, size, hot = None, [], 0, np.zeros(0, dtype[key])

    def split(r, hot):
        return r[~np.isin(r[key], hot)], r[np.isin(r[key], hot)]

    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if part != last:
                if held:
                    yield False, np.concatenate(held)
                    tidy()
                last, held, size, hot = part, [], 0, hot[:0]
            r = np.frombuffer(blob, dtype)
            if len(hot):
                r, some = split(r, hot)
                if len(some):
                    yield True, some
            held.append(r)
            size += r.nbytes
            if size > GATHER:
                r = np.concatenate(held)
                value, count = np.unique(r[key], return_counts=True)
                if (count > HOT).any():
                    hot = np.union1d(hot, value[count > HOT])
                    r, some = split(r, hot)
                    for i in range(0, len(some), 20_000):
                        yield True, some[i : i + 20_000]
                held, size = [r], r.nbytes // 2
    if held:
        yield False, np.concatenate(held)


def hot_batch(r: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> pa.RecordBatch:
    """Note rows (kind 6) of the strings (offsets lo to hi) of hot records; w1 and w2 hash them."""
    row, o = np.nonzero((np.arange(w1.shape[1]) >= r["lo"][:, None]) & (np.arange(w1.shape[1]) <= r["hi"][:, None]))
    x = np.zeros(len(row), WINDOW)
    x["w1"], x["w2"], x["o"] = w1[row, o].view(np.int64), w2[row, o].view(np.int64), o
    x["count"] = 1
    for c in ("id", "uid", "pos", "stride", "count", "q"):
        if c in r.dtype.names:
            x[c] = r[c][row]
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([6], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["q", "kind", "blob"])


def hot_notes(found: DataFrame, note: np.dtype) -> DataFrame:
    """Notes (kind 2) from kind 6: strings of hot anchors that an earlier document holds; equal strings meet in a map-side aggregation."""

    def rows(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                x = np.frombuffer(blob, WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in WINDOW.names], names=list(WINDOW.names))

    each = found.where("kind = 6").select("blob").mapInArrow(rows, "w1 long, w2 long, id long, uid long, pos long, stride int, count int, q int, o int")
    first = each.groupBy("w1", "w2").agg(F.min("id").alias("first"))
    hit = each.join(first, ["w1", "w2"]).where("first < id")
    masks = hit.groupBy("q", "uid", "pos", "stride", "count").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))

    def notes(batches):
        for b in batches:
            if b.num_rows:
                q = b.column(0).to_numpy()
                x = np.zeros(len(q), note)
                x["uid"], x["pos"], x["stride"], x["count"], x["mask"] = (b.column(i).to_numpy() for i in range(1, 6))
                order = np.argsort(q, kind="stable")
                full, at = np.unique(q[order], return_index=True)
                ends = [*at[1:].tolist(), len(q)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), 2, np.int32)), pa.array([x[order[a:e]].tobytes() for a, e in zip(at.tolist(), ends)], pa.binary())], names=["q", "kind", "blob"]
                )

    return masks.mapInArrow(notes, "q int, kind int, blob binary")
