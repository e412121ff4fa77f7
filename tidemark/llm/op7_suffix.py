"""Suffix-array dedup, built column by column.

Only the surroundings of recurring anchors (see ``anchors``) can hold a string
of ``span`` bytes that occurs twice.  Those surroundings are short documents of
equal width.  For each hash range their collection is indexed the way of
column-wise multi-document construction: round by round one symbol of every
document, from the last column to the first, is inserted; the order of all
suffixes of that length follows from the order of the round before by one stable
sort by the symbols before its suffixes (the collection's Burrows-Wheeler
transform), and common prefixes by range minima.  Neighbours whose common
prefix reaches ``span`` are equal strings, whose lowest document is their
source.  The files between rounds of the external method are the sorted runs of
Spark's shuffle, read in order, one hash range at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import LAST, Cells, anchors, gather, hot_batch, hot_notes, owner_hash, pieces, recurring, shared_here
from .common import Work, flat, tidy
from .words import mix

K = 20
#: Records indexed together.
BATCH = 100_000
#: Strings (bits of mask) around the anchors at pos, pos + stride ..., count of them, of one document.
NOTE = np.dtype([("uid", "<i8"), ("pos", "<i8"), ("mask", "<u8"), ("stride", "<i4"), ("count", "<i4")])
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def record(span: int) -> np.dtype:
    """An anchor with its surroundings; strings start at offsets lo to hi of the context."""
    return np.dtype([("h", "<u8"), ("id", "<i8"), ("uid", "<i8"), ("pos", "<i8"), ("stride", "<i4"), ("count", "<i4"), ("q", "<i4"), ("lo", "u1"), ("hi", "u1"), ("ctx", "u1", 2 * span - K)])


def byte_anchors(span: int):
    def of(raw: np.ndarray, at: np.ndarray):
        pos, h = anchors(SYMBOLS[raw], at, K, span)
        return np.searchsorted(at, pos, side="right") - 1, pos, h

    return of


def contexts(raw, at, doc, pos, span: int):
    """(lo, hi, surroundings) of anchors: span - K bytes on both sides; outside the document lo and hi exclude what is read."""
    w = span - K
    padded = np.concatenate([np.zeros(w, np.uint8), raw, np.zeros(w, np.uint8)])
    ctx = np.lib.stride_tricks.sliding_window_view(padded, 2 * span - K)[pos]
    lo = np.maximum(0, at[doc] - (pos - w))
    hi = np.minimum(w, at[doc + 1] - span - (pos - w))
    column = np.arange(2 * span - K)
    ctx = np.where((column >= lo[:, None]) & (column < hi[:, None] + span), ctx, 0).astype(np.uint8)
    return lo, hi, ctx


def digests(r: np.ndarray) -> np.ndarray:
    """64-bit hashes of records' anchors and surroundings."""
    weight = np.random.default_rng(3).integers(1, 1 << 62, r["ctx"].shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = [r["ctx"][s : s + 32768].astype(np.uint64) @ weight for s in range(0, len(r), 32768)]
    return mix(np.concatenate(sums) ^ mix(r["lo"].astype(np.uint64) * np.uint64(256) + r["hi"]) ^ r["h"])


def compress(r: np.ndarray) -> np.ndarray:
    """Records of one document with equal surroundings at equal distances (text that repeats itself) as one with a count."""
    digest = digests(r)
    order = np.lexsort((r["pos"], digest, r["uid"]))
    r, digest = r[order], digest[order]
    same = (digest[1:] == digest[:-1]) & (r["uid"][1:] == r["uid"][:-1])
    step = np.where(same, r["pos"][1:] - r["pos"][:-1], 0)
    go_on = same.copy()
    go_on[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~go_on]))
    count = np.diff(np.concatenate([first, [len(r)]]))
    out = r[first].copy()
    out["count"] = count
    out["stride"] = np.where(count > 1, step[np.minimum(first, len(step) - 1)] if len(step) else 0, 0)
    return out


def spread(note: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, masks) of all anchors of notes."""
    n = note["count"].astype(np.int64)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(note["pos"], n) + np.repeat(note["stride"], n) * turn, np.repeat(note["mask"], n)


def noted(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    note = np.zeros(len(x), NOTE)
    for c in ("uid", "pos", "stride", "count"):
        note[c] = x[c]
    note["mask"] = mask
    return note


def bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A mask with bits lo to hi set."""
    one = np.uint64(1)
    return (one << (hi.astype(np.uint64) + one)) - (one << lo.astype(np.uint64))


def columns_inserted(group: np.ndarray, ctx: np.ndarray, span: int):
    """The collection's transform and common prefixes, round by round.

    Documents (rows of ``ctx``) are in order of ``group``.  Round j, from the last
    column to the first, inserts symbol j of every document before the suffix it
    has so far and yields (j, order, transform, lcp): the documents in order of their
    suffixes from j on, the symbols before those suffixes (0 before whole
    documents), and ``lcp[i]``, the common prefix of the i-th suffix with the one before
    (0 across groups, at most ``span``).  One stable sort by the transform of the round
    before gives the order; range minima of its common prefixes give the new ones.
    """
    m, width = ctx.shape
    order = np.arange(m)
    start = np.concatenate([[True], group[1:] != group[:-1]])
    lcp = np.zeros(m, np.int16)  # empty suffixes
    edge = np.cumsum(start) - 1
    levels = int(np.bincount(edge).max() - 1).bit_length() if m else 0
    transform = ctx[:, width - 1]
    for j in range(width - 1, -1, -1):
        at = np.argsort(edge.astype(np.int64) * 256 + transform, kind="stable")
        sym = transform[at]
        # common prefix with the new neighbour: 1 + range minimum of the old ones between them, if the symbols agree
        low, high = at[:-1] + 1, at[1:]
        agree = (sym[1:] == sym[:-1]) & ~start[1:]
        least = np.zeros(max(0, m - 1), np.int16)
        length = high - low
        table, step = lcp, 1
        for level in range(levels + 1):
            fit = agree & (length + 1 >= step) & (length + 1 < 2 * step)
            if fit.any():
                least[fit] = np.minimum(table[low[fit]], table[high[fit] - step + 1])
            if len(table) <= step:
                break
            table, step = np.minimum(table[:-step], table[step:]), step * 2
        lcp = np.concatenate([[0], np.where(agree, np.minimum(least + 1, span), 0)]).astype(np.int16)
        order = order[at]
        transform = ctx[order, j - 1] if j else np.zeros(m, np.uint8)
        yield j, order, transform, lcp


def column_index(group: np.ndarray, ctx: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    """For every record the offsets (as bits) whose ``span`` symbols also start in a record of the group with a smaller doc."""
    m, width = ctx.shape
    out = np.zeros(m, np.uint64)
    for j, order, _, lcp in columns_inserted(group, ctx, span):
        if j <= width - span:  # suffixes of at least span symbols
            first = np.flatnonzero(lcp < span)
            valid = (lo[order] <= j) & (j <= hi[order])
            source = np.minimum.reduceat(np.where(valid, doc[order], LAST), first)
            source = np.repeat(source, np.diff(np.concatenate([first, [m]])))
            hit = order[valid & (source < doc[order])]
            out[hit] |= np.uint64(1) << np.uint64(j)
    return out


def covered(cells: Cells, span: int, work: Work) -> list[DataFrame]:
    """Notes (q, kind 2, blob) for ``removed``: which strings around which anchors occur in an earlier document."""
    of, bit = byte_anchors(span), cells.owner_bits
    kind_of = record(span)
    answers = recurring(cells, of, work)
    parts = 1 << bit

    def collect(cell, docs):
        wanted, docs = np.unique(cell.blobs(1, "<u8")), list(pieces(cell.fresh(docs)))
        hashes, own, kept = [], [], []
        for rows in docs:
            raw, at = flat(rows.column(2))
            d, p, h = of(raw, at)
            h = owner_hash(h, bit)
            hashes.append(h)
            own.append(rows.column(0).to_numpy()[d])
            kept.append((d.astype(np.int32), p.astype(np.int32)))
        if not docs:
            return
        wanted = np.union1d(wanted, shared_here(hashes, own))
        del own
        held = []
        for rows, h, (d, p) in zip(docs, hashes, kept):
            if not len(wanted):
                break
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            d, p, h = d[hit], p[hit], h[hit]
            raw, at = flat(rows.column(2))
            for i in range(0, len(d), 32768):
                e, p_, h_ = d[i : i + 32768], p[i : i + 32768], h[i : i + 32768]
                r = np.zeros(len(e), kind_of)
                r["lo"], r["hi"], r["ctx"] = contexts(raw, at, e, p_, span)
                r["h"], r["id"], r["uid"], r["pos"], r["q"], r["count"] = h_, rows.column(0).to_numpy()[e], rows.column(1).to_numpy()[e], p_ - at[e], cell.q, 1
                # ordinary text has an anchor every 16 bytes; far more come from text that repeats itself
                held.append(compress(r) if len(d) > len(raw) // 6 else r)
        if not held:
            return
        r = np.concatenate(held)
        del held, hashes, kept
        # equal surroundings within the cell: the earliest document speaks for all, the later ones are covered
        digest = digests(r)
        order = np.lexsort((r["id"], digest))
        r, digest = r[order], digest[order]
        new = np.concatenate([[True], digest[1:] != digest[:-1]])
        first = r["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = r["id"] > first
        if late.any():
            x = r[late]
            note = noted(x, bits(x["lo"], x["hi"]))
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([cell.q], pa.int32()), pa.array([note.tobytes()], pa.binary())], names=["kind", "q", "blob"])
        r = r[~late]
        part = (r["h"] >> np.uint64(48)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        r, part = r[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(full), 3, np.int32)), pa.array(full.astype(np.int32)), pa.array([r[cut[i] : cut[i + 1]].tobytes() for i in full.tolist()], pa.binary())], names=["kind", "q", "blob"]
        )

    found = work.save(cells.each(collect, "kind int, q int, blob binary", answers), "contexts")

    def index(batches):
        def out(r):
            r = r[np.argsort(r["h"], kind="stable")]
            new = np.flatnonzero(np.concatenate([[True], r["h"][1:] != r["h"][:-1]]))
            start = 0
            while start < len(r):  # whole groups, about BATCH records
                k = np.searchsorted(new, start + BATCH)
                end = int(new[k]) if k < len(new) else len(r)
                x = r[start:end]
                start = end
                mask = column_index(x["h"], x["ctx"], x["id"], x["lo"], x["hi"], span)
                hit = np.flatnonzero(mask)
                hit = hit[np.argsort(x["q"][hit], kind="stable")]
                note = noted(x[hit], mask[hit])
                q, first = np.unique(x["q"][hit], return_index=True)
                ends = [*first[1:].tolist(), len(hit)]
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.astype(np.int32)), pa.array(np.full(len(q), 2, np.int32)), pa.array([note[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())], names=["q", "kind", "blob"]
                    )

        for hot, r in gather(batches, kind_of, "h"):
            if not hot:
                yield from out(r)
                continue
            for i in range(0, len(r), 2000):
                x = r[i : i + 2000]
                words = np.lib.stride_tricks.sliding_window_view(x["ctx"], span, axis=1).astype(np.uint64)
                salt = np.random.default_rng(7).integers(1, 1 << 62, (2, span), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                yield hot_batch(x, mix(words @ salt[0] ^ x["h"][:, None]), mix(words @ salt[1]))

    part = found.where("kind = 3").select("q", "blob").repartition("q").sortWithinPartitions("q")
    far = work.save(part.mapInArrow(index, "q int, kind int, blob binary"), "indexed")
    notes = [found.where("kind = 2").select("q", "kind", "blob"), far.where("kind = 2")]
    return notes if far.where("kind = 6").isEmpty() else [*notes, work.save(hot_notes(far, NOTE), "hot")]


def gone(n: int, pos: np.ndarray, mask: np.ndarray, span: int) -> np.ndarray:
    """Which of n symbols the noted strings cover; anchors at ``pos``, bit o for the string from pos - (span - K) + o."""
    change = np.zeros(n + 1, np.int64)
    o = np.arange(span - K + 1)
    row, off = np.nonzero((mask[:, None] >> o.astype(np.uint64)) & np.uint64(1))
    at = pos[row] - (span - K) + off
    np.add.at(change, at, 1)
    np.add.at(change, at + span, -1)
    return np.cumsum(change[:-1]) > 0


def each_document(cell, docs, span: int):
    """(slice of documents, index, bytes, removed) for every document of a cell with notes."""
    notes = cell.blobs(2, NOTE)
    notes = notes[np.argsort(notes["uid"], kind="stable")]
    for rows in pieces(docs):
        raw, at = flat(rows.column(2))
        uid = rows.column(1).to_numpy()
        first, last = np.searchsorted(notes["uid"], uid, "left"), np.searchsorted(notes["uid"], uid, "right")
        for i in range(rows.num_rows):
            n = int(at[i + 1] - at[i])
            if int(uid[i]) in cell.copies:
                dead = np.ones(n, bool)
            elif first[i] < last[i]:
                x = notes[first[i] : last[i]]
                dead = gone(n, *spread(x), span)
            else:
                dead = None
            yield rows, i, raw[at[i] : at[i + 1]], dead


def spans_of(dead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], dead.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, work: Work | None = None, whole_characters: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, kept, spans): the text's bytes without those covered by a ``span``-byte string that also starts in a document with a smaller id.

    ``spans`` are the maximal removed runs (start, end).  Matches never cross
    documents and are judged on the input.  Null text is empty; a null id comes
    after all others and is returned as null; rows with equal ids are one
    document's versions and never remove each other's bytes; texts shorter than
    ``span`` stay.  Of other columns, the strings named in ``columns`` are
    returned and the rest is ignored; an empty table gives no rows.  With
    ``whole_characters`` a character that is removed in part stays, so that what is kept is UTF-8.
    """
    work = work or Work(docs.sparkSession, "suffix")
    cells = Cells(docs, id_col, text_col, span, work, columns)
    notes = covered(cells, span, work)

    def cut(cell, docs):
        ids, size, kept, spans, more = [], [], [], [], [[] for _ in columns]

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), *[pa.array(x, pa.string()) for x in more]],
                names=["id", "n_bytes", "kept", "spans", *columns],
            )

        held = 0
        for rows, i, raw, dead in each_document(cell, docs, span):
            if dead is not None and whole_characters:
                lead = np.cumsum((raw & 0xC0) != 0x80) - 1  # each byte's character
                whole = np.bincount(lead, ~dead) == 0
                dead = whole[lead]
            a, b = spans_of(dead) if dead is not None else ((), ())
            ids.append(rows.column(0)[i].as_py())
            size.append(len(raw))
            kept.append((raw if dead is None else raw[~dead]).tobytes())
            spans.append([[int(x), int(y)] for x, y in zip(a, b)])
            for k, x in enumerate(more):
                x.append(rows.column(3 + k)[i].as_py())
            held += len(raw) + 64
            if held > 2 << 20:
                yield out()
                ids, size, kept, spans, held, more = [], [], [], [], 0, [[] for _ in columns]
        if ids:
            yield out()

    schema = "id long, n_bytes long, kept binary, spans array<array<long>>" + "".join(f", {c} string" for c in columns)
    out = cells.each(cut, schema, *notes, payload=True)
    return out.withColumn("id", F.when(F.col("id") < LAST, F.col("id"))).withColumnRenamed("id", id_col)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
