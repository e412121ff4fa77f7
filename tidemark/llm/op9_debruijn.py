"""Substring dedup on a compacted de Bruijn graph of words.

Every window of ``span`` words is an edge, named by its hash, from the node of
its first words to that of its last; only edges that occur in several documents
matter.  Those are found in two steps, both aggregated before they are shuffled:
a window can recur only if its lowest k-gram (its minimizer) does, so the
minimizers of all documents are counted first, and then the windows around those
that recur.  An edge all of whose occurrences have one and the same edge before
and one and the same after lies inside a nonbranching path.  A join brings each
edge's earliest document and place on paths to its occurrences, where repeated
nonbranching paths become single rows: a path's source and its coordinates in
every document.  The words at all coordinates of a path are then compared; paths whose words
differ (hashes collide) are taken apart by their words.

Texts are dealt once, into buckets of documents that later passes read where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import LAST, kgrams, slide
from .common import Work, flat, hot_join, parts, slices, tidy
from .words import mix, powers, word_hashes, word_spans

#: Words of a minimizer.
K = 20
#: Text bytes of a bucket of documents, and the most buckets of a table.
BUCKET, MOST_BUCKETS = 16 << 20, 100_000


def words_of(raw: np.ndarray, at: np.ndarray):
    """(word hashes, first word of each document and the end)."""
    start, end, doc = word_spans(raw, at)
    return word_hashes(raw, start, end), np.searchsorted(doc, np.arange(len(at)), side="left")


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, by position-free polynomial sums."""
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix(((total[end] - total[start]) * down[start]) ^ mix((end - start).astype(np.uint64)))


def minimizers(h: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of ``span`` words within one document, the lowest k-gram hash of each)."""
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = slide(np.minimum, kgrams(h, K), span - K + 1)
    end = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(low)) + span <= end[: len(low)])
    return start, mix(low[start])


def lines(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words, each followed by a space; where each word begins in them, and the end)."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(at[-1], 32, np.uint8)
    done = np.cumsum(n) - n
    each = np.arange(n.sum())
    out[np.repeat(at[:-1] - done, n) + each] = raw[np.repeat(start - done, n) + each]
    return out, at


class Graph:
    """Documents of a table in buckets, and the compacted paths of their repeated windows."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, span: int, bits: int, work: Work):
        self.span, self.bits, self.work = span, bits, work
        text = F.coalesce(F.col(text_col), F.lit(""))
        size = F.octet_length(text).cast("long")
        self.n = min(MOST_BUCKETS, max(parts(work.spark), -(-(docs.agg(F.sum(size)).first()[0] or 0) // BUCKET)))
        rows = docs.select(
            F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"),
            size.alias("n"), F.xxhash64(F.lit(6), text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
        )
        self.docs = work.bucketed(rows, "docs", "uid", self.n)
        # copies of whole texts, which an earlier document covers
        keys = self.docs.where(F.col("n") >= 2 * span - 1).select("uid", "id", "h1", "h2", "n")
        first = work.save(keys.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1"), "first")
        self.copies = work.save(hot_join(keys, first, ["h1", "h2", "n"], "c").where("id > first").select("uid"), "copies")

    def with_notes(self, notes: DataFrame, how: str) -> DataFrame:
        """Documents (uid, id, text) joined with notes, one row a document; only the notes move."""
        return self.docs.select("uid", "id", "text").join(notes.hint("shuffle_hash"), "uid", how)

    def grouped(self, rows: DataFrame, *values) -> DataFrame:
        """One row a document; the lists are no longer than the document."""
        return rows.repartition(self.n, "uid").groupBy("uid").agg(*values)

    def recurring(self) -> DataFrame:
        """(uid, values): the minimizers of each document that other documents hold too."""
        span = self.span

        def run(batches):
            for b in slices(batches, 2):
                h, first = words_of(*flat(b.column(2)))
                start, low = minimizers(h, first, span)
                if len(start):
                    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (np.diff(start) > 1)]))
                    doc = np.searchsorted(first, start[new], side="right") - 1
                    low = low[new]
                    order = np.lexsort((low, doc))
                    doc, low = doc[order], low[order]
                    keep = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                    doc, low = doc[keep], low[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc))], names=["v", "uid", "id"])

        fresh = self.with_notes(self.copies.repartition(self.n, "uid"), "left_anti")
        rows = self.work.save(fresh.mapInArrow(run, "v long, uid long, id long"), "minimizers")
        shared = rows.groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("c")).where("a < b")
        shared = self.work.save(shared.select("v", "c"), "shared")
        return self.grouped(hot_join(rows, shared, ["v"], "c"), F.collect_list("v").alias("values"))

    def edges(self) -> DataFrame:
        """(e, id, uid, pos, near): windows whose minimizer recurs; near is the edges before and after (32 bits each, 0: none)."""
        span, mask = self.span, np.uint64((1 << self.bits) - 1)

        def run(batches):
            for b in slices(batches, 2):
                h, first = words_of(*flat(b.column(2)))
                start, low = minimizers(h, first, span)
                s = start[np.isin(low.view(np.int64), b.column(3).flatten().to_numpy())]
                for i in range(0, len(s), 1 << 17):
                    part = s[max(0, i - 1) : i + (1 << 17) + 1]  # with the neighbours
                    e = range_hashes(h, part, part + span) & mask
                    code = e & np.uint64(0xFFFFFFFF) | np.uint64(1)
                    joined = np.diff(part) == 1
                    before = np.concatenate([[0], np.where(joined, code[:-1], 0)]).astype(np.uint64)
                    after = np.concatenate([np.where(joined, code[1:], 0), [0]]).astype(np.uint64)
                    near = before << np.uint64(32) | after
                    own = slice(min(i, 1), min(i, 1) + min(1 << 17, len(s) - i))
                    doc = np.searchsorted(first, part[own], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(e[own].view(np.int64)), b.column(1).take(pa.array(doc)), b.column(0).take(pa.array(doc)), pa.array(part[own] - first[doc]), pa.array(near[own].view(np.int64))],
                        names=["e", "id", "uid", "pos", "near"],
                    )

        return self.work.save(self.with_notes(self.recurring(), "inner").mapInArrow(run, "e long, id long, uid long, pos long, near long"), "edges")

    def paths(self) -> DataFrame:
        """(path, uid, id, start, n, source): every occurrence of a repeated path of n edges; source is its earliest document."""
        edges = self.edges()
        self.work.drop("minimizers", "shared")
        info = edges.groupBy("e").agg(F.min("id").alias("source"), F.max("id").alias("b"), F.count("*").alias("c"), F.min("near").alias("x"), F.max("near").alias("y")).where("source < b")
        inside = (F.col("x") == F.col("y")) & (F.shiftrightunsigned("x", 32) != 0) & (F.col("x").bitwiseAND(0xFFFFFFFF) != 0)
        info = self.work.save(info.select("e", "source", "c", inside.alias("inside")), "info")
        order = W.partitionBy("uid").orderBy("pos")  # a document's own windows
        head = ~F.col("inside") | ~F.coalesce(F.lag("inside").over(order), F.lit(False)) | (F.lag("pos").over(order) != F.col("pos") - 1)
        runs = hot_join(edges, info, ["e"], "c").withColumn("head", F.when(head, 1).otherwise(0))
        runs = runs.withColumn("run", F.sum("head").over(order))
        runs = runs.groupBy("uid", "run").agg(F.min_by("e", "pos").alias("path"), F.min("id").alias("id"), F.min("pos").alias("start"), F.count("*").alias("n"), F.min("source").alias("source"))
        found = self.work.save(runs.drop("run"), "paths")
        self.work.drop("edges", "info")
        return found

    def texts(self, paths: DataFrame, with_place: bool) -> DataFrame:
        """(path, words) of the occurrences, (path, words, uid, id, start, n) with their places."""
        span = self.span
        notes = self.grouped(paths, F.collect_list(F.struct("start", "n", "path")).alias("at"))
        kind = "path long, words binary" + (", uid long, id long, start long, n long" if with_place else "")

        def run(batches):
            for b in slices(batches, 2, 1 << 22):
                raw, at = flat(b.column(2))
                begin, end, doc = word_spans(raw, at)
                first = np.searchsorted(doc, np.arange(len(at)), side="left")
                line, place = lines(raw, begin, end)
                lists = b.column(3)
                start, n, path = (x.to_numpy() for x in lists.flatten().flatten())
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                a, z = place[first[row] + start], place[first[row] + start + n + span - 1] - 1
                if with_place:
                    keep = np.arange(len(a))
                    words = [line[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist())]
                else:
                    unique = {}
                    for i, (p, x, y) in enumerate(zip(path.tolist(), a.tolist(), z.tolist())):
                        unique.setdefault((p, line[x:y].tobytes()), i)
                    keep, words = np.fromiter(unique.values(), np.int64, len(unique)), [w for _, w in unique]
                for i in range(0, len(keep), 4096):
                    k = keep[i : i + 4096]
                    more = [b.column(0).take(pa.array(row[k])), b.column(1).take(pa.array(row[k])), pa.array(start[k]), pa.array(n[k])] if with_place else []
                    yield pa.RecordBatch.from_arrays([pa.array(path[k]), pa.array(words[i : i + 4096], pa.binary()), *more], names=[c.split()[0] for c in kind.split(", ")])

        return self.with_notes(notes, "inner").mapInArrow(run, kind)

    def removed(self) -> DataFrame:
        """(uid, start, n): occurrences of paths whose words an earlier document holds, compared word by word."""
        paths = self.paths()
        bad = self.texts(paths, False).distinct().groupBy("path").agg(F.count("*").alias("kinds")).where("kinds > 1")
        bad = self.work.save(bad.select("path"), "collisions")
        if bad.isEmpty():
            return paths.where("source < id").select("uid", "start", "n")
        fine = paths.where("source < id").join(bad, "path", "left_anti").select("uid", "start", "n")
        each = self.work.save(self.texts(paths.join(bad, "path", "left_semi"), True), "apart")
        kinds = self.work.save(each.groupBy("path", "words").agg(F.min("id").alias("source"), F.count("*").alias("c")), "kinds")
        return fine.unionByName(hot_join(each, kinds, ["path", "words"], "c").where("source < id").select("uid", "start", "n"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, work: Work | None = None, bits: int = 64) -> DataFrame:
    """(id, n_words, kept, spans): the text's words, joined by a space, without those covered by a window of ``span`` words that also starts in a document with a smaller id.

    ``spans`` are the maximal removed runs (first word, end).  Windows never
    cross documents and are judged on the input.  Null text has no word; a null
    id comes after all others and is returned as null; rows with equal ids never
    remove each other's words, and repeated rows repeat; texts are read whole, however long.  Other
    columns are ignored; an empty table gives no rows.  ``bits`` of an edge's hash
    are used; with few of them windows collide and are told apart by their words.
    """
    work = work or Work(docs.sparkSession, "debruijn")
    graph = Graph(docs, id_col, text_col, span, bits, work)
    none = F.lit(None).cast("struct<start:bigint,n:bigint>")
    gone = work.save(graph.removed().select("uid", F.struct("start", "n").alias("at")).unionByName(graph.copies.select("uid", none.alias("at"))), "gone")
    notes = graph.grouped(gone, F.collect_list("at").alias("at"), F.max(F.col("at").isNull()).alias("copy"))

    def cut(batches):
        for b in slices(batches, 2, 1 << 22):
            m = b.num_rows
            raw, at = flat(b.column(2))
            begin, end, doc = word_spans(raw, at)
            first = np.searchsorted(doc, np.arange(m + 1), side="left")
            size = np.diff(first)
            lists = b.column(3).fill_null([])
            start, n = (x.to_numpy() for x in lists.flatten().flatten()) if len(lists.flatten()) else (np.zeros(0, np.int64),) * 2
            row = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
            change = np.zeros(len(begin) + 1, np.int64)
            np.add.at(change, first[row] + start, 1)
            np.add.at(change, first[row] + start + n + span - 1, -1)
            dead = np.cumsum(change[:-1]) > 0
            copy = b.column(4).fill_null(False).to_numpy(zero_copy_only=False) & (size >= span)
            dead |= np.repeat(copy, size)
            line, place = lines(raw, begin[~dead], end[~dead])
            alive = np.concatenate([[0], np.cumsum(~dead)])[first]
            lo, hi = place[alive[:-1]], place[alive[1:]] - (np.diff(alive) > 0)
            edge = np.concatenate([[True], dead[1:] != dead[:-1]])
            edge[np.minimum(first[:-1][size > 0], max(0, len(dead) - 1))] = True  # runs end with their document
            turn = np.flatnonzero(edge) if len(dead) else np.zeros(0, np.int64)
            stop = np.concatenate([turn[1:], [len(dead)]])
            turn, stop = turn[dead[turn]], stop[dead[turn]]
            owner = np.searchsorted(first, turn, side="right") - 1
            spans = [[] for _ in range(m)]
            for d, x, y in zip(owner.tolist(), (turn - first[owner]).tolist(), (stop - first[owner]).tolist()):
                spans[d].append([x, y])
            kept = [line[x:y].tobytes().decode() for x, y in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(size.astype(np.int64)), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["id", "n_words", "kept", "spans"]
            )
        tidy()

    out = graph.with_notes(notes, "left").mapInArrow(cut, "id long, n_words long, kept string, spans array<array<long>>")
    return out.withColumn("id", F.when(F.col("id") < LAST, F.col("id"))).withColumnRenamed("id", id_col)
