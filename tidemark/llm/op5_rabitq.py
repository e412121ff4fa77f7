"""Embedding near-dedup with randomised-rotation binary codes.

Every unit vector is rotated at random; the signs are its code, and the inner
product of code and vector its stored correction factor.  The rotated vector is
also kept in four bits a component, dithered.  Code of one times those of the
other, over the factor, estimates the cosine of a pair without bias and with a
known confidence bound.  Only codes, factors and bucket keys travel to the
buckets; a vector is fetched there only if a pair of its bucket has bounds that
reach the threshold, and such pairs alone are computed exactly.  Buckets are slices of the signs of
further rotations: their width follows the number of vectors and their number
the recall asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, Work, binary_column, hot_join, small
from .components import components

#: Rows of a bucket compared in one block; larger buckets become pairs of blocks.
BLOCK = 512
#: Width of the confidence bounds in standard deviations.
SIGMAS = 4.5
#: Four bits a component: steps from the middle to the largest component.
STEPS = 7


def rotations(dim: int, n: int, seed: int = 7) -> np.ndarray:
    """n random orthogonal dim x dim matrices side by side."""
    rng = np.random.default_rng([seed, dim])
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, number of tables): about 16 vectors a bucket, and ``recall`` for a pair just at the threshold."""
    bits = min(31, max(2, round(math.log2(max(n, 4) / 16))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def encode(x: np.ndarray, turn: np.ndarray, bits: int, count: int):
    """(keys rows x tables, codes packed, factors, steps, quarter bytes packed) of unit vectors."""
    dim = x.shape[1]
    turned = x @ turn
    signs = turned > 0
    weights = (1 << np.arange(bits, dtype=np.int64))
    need = signs[:, dim : dim + bits * count].reshape(len(x), count, bits)
    keys = (need @ weights).astype(np.int32)
    own = turned[:, :dim]
    factor = np.abs(own).sum(1) / math.sqrt(dim)
    step = np.abs(own).max(1) / STEPS
    level = np.clip(np.rint(own / step[:, None] + dither(dim)), -8, 7).astype(np.int64) + 8
    level = np.pad(level, ((0, 0), (0, dim % 2))).astype(np.uint8)
    return keys, np.packbits(signs[:, :dim], axis=1), factor, step, level[:, ::2] | level[:, 1::2] << 4


def dither(dim: int) -> np.ndarray:
    return np.random.default_rng([5, dim]).random(dim) - 0.5


def decode(code: np.ndarray, step: np.ndarray, level: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the codes, rotated vectors as kept)."""
    c = (np.unpackbits(code, axis=1)[:, :dim].astype(np.float32) * 2 - 1) / math.sqrt(dim)
    wide = np.stack([level & 15, level >> 4], 2).reshape(len(level), -1)[:, :dim].astype(np.float32) - 8
    return c, ((wide - dither(dim)) * step[:, None]).astype(np.float32)


def bounds(factor: np.ndarray, step: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What an estimate by the first's code may err, for the first of a pair and for the second (kept in steps)."""
    return SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, dim - 1)) / factor, SIGMAS * step / math.sqrt(12)


def undecided(code, factor, step, level, keys, table, side, i, j, threshold, dim):
    """Pairs (a, b) of a block that may reach the threshold, owned by this table: the first in which they share a key."""
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    c, q = decode(code, step, level, dim)
    own, other = bounds(factor, step, dim)
    one = (c[left] @ q[right].T + other[right][None, :]) / factor[left][:, None] + own[left][:, None]
    two = one.T if i == j else (q[left] @ c[right].T + other[left][:, None]) / factor[right][None, :] + own[right][None, :]
    a, b = np.nonzero((one >= threshold) & (two >= threshold))
    if i == j:
        a, b = a[a < b], b[a < b]
    a, b = left[a], right[b]
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 65536):
        p, q = a[s : s + 65536], b[s : s + 65536]
        out[s : s + 65536] = ~(keys[p, :table] == keys[q, :table]).any(1)
    return a[out], b[out]


def linked(raw: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, in double precision."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    norm, out = np.linalg.norm(raw, axis=1), np.zeros(len(a), bool)
    for s in range(0, len(a), 65536):
        p, q = a[s : s + 65536], b[s : s + 65536]
        out[s : s + 65536] = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= threshold
    return out


def near_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.999, work: Work | None = None) -> DataFrame:
    """(id, n_links, component_id, kept): one row a vector.

    Links have cosine >= threshold in double precision, always computed
    exactly; a pair just at the threshold is found with probability ``recall``,
    closer pairs with more.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and neither do vectors of different
    length.  Equal vectors are one point with a count: they link with
    each other and share all other links.  Repeated rows are copies; an empty table
    gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    work = work or Work(spark, "rabitq")
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    kind = "<f8" if wide else "<f4"
    vec = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    tagged = rows.withColumn("ok", fine & F.col("id").isNotNull()).withColumn("h1", F.xxhash64(F.lit(1), vec)).withColumn("h2", F.xxhash64(F.lit(2), vec))
    points = work.save(
        tagged.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("h1", "h2", "dim")), "points"
    )
    n = points.count()
    dims = [r["dim"] for r in points.select("dim").distinct().collect()]
    found = None
    for dim in dims:  # one length as a rule
        links = _links(points.where(F.col("dim") == dim), dim, n, kind, threshold, recall, work)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "src long, dst long, n long")
    found = work.save(found, "found")
    label = work.save(components(found.where("dst is not null").select("src", "dst"), work), "labels")
    counts = found.where("dst is null").groupBy(F.col("src").alias("key")).agg(F.sum("n").alias("n"))
    label = work.save(points.select("key", "rep").join(label.withColumnRenamed("id", "key"), "key"), "labelled")
    low = work.save(label.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("c")), "lowest")  # a component's smallest id
    label = hot_join(label, low, ["component"], "c").select("key", "low")
    per = points.select("key", "rep", "h1", "h2", "mult").join(counts, "key", "left").join(label, "key", "left")
    per = work.save(per.select("h1", "h2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id")), "per")
    keyed = work.save(tagged.where("ok").select("id", "h1", "h2"), "keyed")
    fine = hot_join(keyed, per, ["h1", "h2"], "mult").select("id", "n_links", "component_id")
    alone = tagged.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return fine.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


CODED = "rep long, mult long, vec binary, code binary, factor double, step double, level binary, keys binary"


def _links(points: DataFrame, dim: int, n: int, kind: str, threshold: float, recall: float, work: Work) -> DataFrame:
    """(src, dst, n): linked copies of src where dst is null, else an edge of a spanning forest."""
    bits, count = tables(n, threshold, recall)
    turn_count = 1 + -(-bits * count // dim)
    wide = lambda a, m: binary_column(np.ascontiguousarray(a).tobytes(), np.arange(m + 1) * (a.nbytes // m))

    def code(batches):
        turn = rotations(dim, turn_count)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                m = part.num_rows
                raw = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = raw.astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                keys, bit, factor, step, level = encode(x / np.linalg.norm(x, axis=1, keepdims=True), turn, bits, count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), wide(raw.astype(kind), m), wide(bit, m), pa.array(factor), pa.array(step), wide(level, m), wide(keys.astype("<i4"), m)],
                    names=[c.split()[0] for c in CODED.split(", ")],
                )

    coded = work.save(points.select(F.col("key").alias("rep"), "mult", "v").mapInArrow(code, CODED), f"coded-{dim}")

    def buckets(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, count)
                for t in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t].astype(np.int64) | (t << 32)), b.column(0)], names=["bucket", "rep"])

    rows = coded.select("rep", "keys").mapInArrow(buckets, "bucket long, rep long")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    sizes = work.save(sizes.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).select("bucket", "blocks"), f"buckets-{dim}")
    hot = sizes.where("blocks > 1")
    hot = small(hot, hot.count())

    def spread(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(5).to_pylist()), "<i4").reshape(b.num_rows, count)
                for t in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t].astype(np.int64) | (t << 32)), *b.columns], names=["bucket", *b.schema.names])

    light = ["rep", "code", "factor", "step", "level", "keys"]
    rows = coded.select(*light).mapInArrow(spread, "bucket long, " + ", ".join(c for c in CODED.split(", ") if c.split()[0] in light))
    rows = rows.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["bucket", F.least("side", "other").cast("int").alias("i"), F.greatest("side", "other").cast("int").alias("j"), "side"]
    rows = rows.select(*place, *light).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def pairs(group, k):
        """Undecided pairs of a block whose codes are in the columns from the k-th on."""
        m = group.num_rows
        col = lambda k, t: np.frombuffer(b"".join(group.column(k).to_pylist()), t).reshape(m, -1)
        bucket, i, j = (group.column(c)[0].as_py() for c in range(3))
        return undecided(
            col(k, np.uint8), group.column(k + 1).to_numpy(), group.column(k + 2).to_numpy(), col(k + 3, np.uint8), col(k + 4, "<i4"), bucket >> 32, group.column(3).to_numpy(), i, j, threshold, dim
        )

    def decide(batches):
        for group in grouped(batches, 3):
            if group.num_rows > 1:
                a, b = pairs(group, 5)
                if len(a):
                    yield group.select(["bucket", "i", "j", "side", "rep"]).take(pa.array(np.union1d(a, b)))

    need = work.save(rows.mapInArrow(decide, "bucket long, i int, j int, side int, rep long"), f"undecided-{dim}")
    full = need.join(coded, "rep").select("bucket", "i", "j", "side", "rep", "mult", "vec", *light[1:])
    full = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches):
        for group in grouped(batches, 3):
            m = group.num_rows
            a, b = pairs(group, 7)
            good = linked(np.frombuffer(b"".join(group.column(6).to_pylist()), kind).reshape(m, dim).astype(np.float64), a, b, threshold)
            a, b = a[good], b[good]
            if not len(a):
                continue
            rep, mult = group.column(4).to_numpy(), group.column(5).to_numpy()
            total = np.bincount(a, mult[b], m) + np.bincount(b, mult[a], m)
            forest, src, dst = UnionFind(m), [], []
            for p, q in zip(a.tolist(), b.tolist()):
                if forest.union(p, q):
                    src.append(p)
                    dst.append(q)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[hit], rep[src]]).astype(np.int64)), pa.array([None] * len(hit) + rep[dst].tolist(), pa.int64()),
                 pa.array(np.concatenate([total[hit].astype(np.int64), np.zeros(len(src), np.int64)]))], names=["src", "dst", "n"],
            )

    return full.mapInArrow(compare, "src long, dst long, n long")


def grouped(batches, width: int):
    """Runs of rows with equal first ``width`` columns of a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(width)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        at = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            key = tuple(k[a] for k in keys)
            if key != last and held:
                yield _joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
