"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles, embedded as ``SLOTS`` min-hash
tokens.  In each run a set goes to the buckets named by tokens that a random
function chooses, so similar sets meet.  Buckets are split until they are small, and small ones are compared by brute force on their
tokens.  In a larger bucket, sets that are alike to much of it would go on
together for ever: they are compared with the whole bucket and leave it, the
others go on, by slots that a random function of the path chooses, never the same slot twice.
They take as many slots at once as make the bucket small: if slots are taken one by one, what a set
goes on by multiplies with every slot, and rows grow nearly with the square of a group of sets a
third alike.  Taken at once, ``tuples_needed`` choices are enough for the recall asked for.

Sets that met and look similar form candidate groups, in which Jaccard
similarity is computed exactly from the whole sets, in blocks.  In a group of
several blocks a set goes only to those blocks where it met a set that looks
similar, so groups that hang together by chains cost what their pairs cost.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, Work, binary_column, flat, semi_reduce, slices, tasks
from .components import components
from .op5_rabitq import grouped
from .words import mix, shingles

SLOTS = 64
#: A bucket of at most so many sets is compared by brute force at once.
SMALL = 256
#: Tokens of those shared with a set at the threshold that a set starts by in a run, on average.
FAN = 1.8
#: Most slots taken at once; a bucket that needs more is split again.
DEPTH = 4
#: A set that agrees with a bucket in this part of its slots on average is compared with all of it; the buckets of others shrink to less than that with each slot.
DENSE = 0.35
#: Sets of a block in a brute-force comparison.
BLOCK = 1024
#: Sets of a large bucket among which one is judged dense or not.
LOOK = 256
#: Part of the pairs that may be lost whose sketches may look too different.
LOST_BY_SKETCH = 0.1
#: Part of the pairs that may be lost that start in no bucket together.
LOST_AT_START = 0.01


def agreeing(threshold: float) -> list[float]:
    """Probability that the sketches of a pair at the threshold agree in 0, 1 .. SLOTS slots."""
    return [math.comb(SLOTS, m) * threshold**m * (1 - threshold) ** (SLOTS - m) for m in range(SLOTS + 1)]


def least_slots(recall: float, threshold: float) -> int:
    """Equal slots from which sketches look similar; fewer cost a tenth of the pairs that may be lost."""
    m, lost = 0, 0.0
    for share in agreeing(threshold):
        lost += share
        if lost > LOST_BY_SKETCH * (1 - recall):
            break
        m += 1
    return m


def chance(threshold: float) -> float:
    """The probability with which a set goes on by a slot."""
    return min(1.0, FAN / (threshold * SLOTS))


def missed(runs: int, recall: float, threshold: float, depth: int = 0, tuples: int = 0, rounds: int = 0) -> float:
    """Share of the pairs at the threshold that are not found in ``runs`` runs.

    A pair starts together by each chosen slot in which its sketches agree.  In each of
    ``rounds`` rounds its bucket is too large to compare, and the pair goes on together by each of ``tuples``
    choices of ``depth`` slots, of those that its path has not used, in all of which its sketches agree.
    """
    step, least, out = chance(threshold), least_slots(recall, threshold), 0.0
    for m, share in enumerate(agreeing(threshold)):
        once = 1.0
        for used in reversed([1 + depth * r for r in range(rounds)]):
            once = 1 - (1 - math.comb(max(0, m - used), depth) / math.comb(SLOTS - used, depth) * once) ** tuples
        out += share * ((1 - step * once) ** (m * runs) if m >= least else 1.0)
    return out


def runs_needed(recall: float, threshold: float) -> int:
    """Runs after which nearly all pairs at the threshold with similar sketches have started together."""
    runs, lost = 1, sum(agreeing(threshold)[: least_slots(recall, threshold)])
    while missed(runs, recall, threshold) - lost > LOST_AT_START * (1 - recall):
        runs += 1
    return runs


def depth_of(m: int, small: int) -> int:
    """Slots after which a bucket of m sets is about small, if it shrinks to DENSE with each."""
    return max(1, round(math.log(max(m, 1) / small) / -math.log(DENSE)))


def tuples_needed(depth: int, rounds: int, recall: float, threshold: float) -> int:
    """Choices of ``depth`` slots a round with which a pair at the threshold is found with probability ``recall``."""
    tuples, runs = 1, runs_needed(recall, threshold)
    while missed(runs, recall, threshold, depth, tuples, rounds) > 1 - recall:
        tuples += 1
    return tuples


def sketch(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n x SLOTS 32-bit min-hashes; documents must be in order and have a shingle each to get one."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((n, SLOTS), np.uint32)
    have, first = np.unique(docs, return_index=True)
    if len(have):
        for j in range(SLOTS):
            out[have, j] = np.minimum.reduceat(((values * factors[j]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def choose(tokens: np.ndarray, run: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, path, slots used by it) for every token by which a row starts in a run."""
    slot = np.arange(SLOTS, dtype=np.uint64)
    h = mix(mix(np.array([run], np.uint64)) + (tokens.astype(np.uint64) | slot << np.uint64(32)))
    row, col = np.nonzero(mix(h + np.uint64(1)) <= np.uint64(min((1 << 64) - 1, int(2.0**64 * chance(threshold)))))
    return row, h[row, col].view(np.int64), (np.uint64(1) << slot[col]).view(np.int64)


def go_on(tokens: np.ndarray, path: int, used: int, depth: int, tuples: int) -> tuple[np.ndarray, np.ndarray]:
    """(longer paths, slots used by them) of the rows of one bucket, ``tuples`` x rows; each takes ``depth`` slots, or all that are left."""
    seed, slot = np.array([path], np.int64).view(np.uint64), np.arange(SLOTS, dtype=np.uint64)
    free = np.flatnonzero([not used >> j & 1 for j in range(SLOTS)])
    paths, after = np.zeros((tuples if len(free) else 0, len(tokens)), np.int64), np.zeros((tuples if len(free) else 0, len(tokens)), np.int64)
    for k in range(len(paths)):
        h = mix(seed + np.uint64(2 * k + 1))
        taken = np.sort(free[np.argsort(mix(h + slot[free]), kind="stable")[:depth]])
        bits = np.bitwise_or.reduce(np.uint64(1) << slot[taken])
        for j in taken:
            h = mix(h + (tokens[:, j].astype(np.uint64) | slot[j] << np.uint64(32)))
        paths[k], after[k] = h.view(np.int64), np.array([used], np.int64) | bits.view(np.int64)
    return paths, after


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, with_sketch: bool) -> DataFrame:
    """(id, row_key, n, d1, d2, data): distinct shingles counted and digested; data is the sketch or the sorted set."""

    def run(batches):
        for b in slices(batches, 1, 1 << 20):
            raw, at = flat(b.column(1))
            m = b.num_rows
            d, v = shingles(raw, at, width)
            order = np.lexsort((v, d))
            d, v = d[order], v[order]
            keep = np.ones(len(d), bool)
            keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
            d, v = d[keep], v[keep]
            n = np.bincount(d, minlength=m)
            s1, s2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            np.add.at(s1, d, mix(v + np.uint64(3)))
            np.add.at(s2, d, mix(v ^ np.uint64(0x5555555555555555)))
            if with_sketch:
                data = binary_column(sketch(d, v, m).tobytes(), np.arange(m + 1) * 4 * SLOTS)
            else:
                data = binary_column(v.tobytes(), np.concatenate([[0], np.cumsum(n * 8)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), data], names=["id", "row_key", "n", "d1", "d2", "data"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("row_key"))
    return rows.mapInArrow(run, "id long, row_key long, n long, d1 long, d2 long, data binary")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Tells rows with one id apart; equal rows agree."""
    return F.xxhash64(F.col(id_col).cast("long"), F.lit(9), F.col(text_col))


def _blocks(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """Deals the rows (rep, path, dense, m) of buckets of m sets to pairs of blocks (i, j), then brings the payload (rep, ...) there.

    Blocks are chosen on narrow rows, so the payload is shuffled twice at most.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("path", F.least("side", "other").cast("int").alias("i"), F.greatest("side", "other").cast("int").alias("j"), "side", "dense", "rep")
    return rows.join(payload, "rep").select("path", "i", "j", "side", "dense", "rep", *[c for c in payload.columns if c != "rep"]).repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SLOTS)


def _alike(g, low: float):
    """(p, rows alike to p in at least ``low`` of the slots) of a block pair (path, i, j, side, dense, rep, data).

    One of two rows is dense, and they lie on both sides.
    """
    i, j, side, dense = g.column(1)[0].as_py(), g.column(2)[0].as_py(), g.column(3).to_numpy(), g.column(4).to_numpy(zero_copy_only=False)
    tokens = _sketches(g.column(6))
    for p in np.flatnonzero(side == i).tolist():
        rest = np.arange(p + 1, g.num_rows) if i == j else np.flatnonzero(side == j)
        if not dense[p]:
            rest = rest[dense[rest]]
        if len(rest):
            yield p, rest, lambda some, p=p: some[(tokens[some] == tokens[p]).mean(1) >= low]


def _forest_rows(batches, low: float):
    """A spanning forest of the sets of each block pair that look similar."""
    for g in grouped(batches, 3):
        m = g.num_rows
        if m < 2:
            continue
        ids, forest, src, dst = g.column(5).to_numpy(), UnionFind(m), [], []
        group = np.arange(m)  # lowest row of each row's group
        for p, rest, alike in _alike(g, low):
            near = alike(rest[group[rest] != group[p]])
            for q in near.tolist():
                if forest.union(p, q):
                    src.append(p)
                    dst.append(q)
            if len(near):
                group[np.isin(group, np.unique(group[near]))] = group[p]
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst])], names=["src", "dst"])


def _met_rows(batches, low: float):
    """(rep, other): the blocks of a set's group (grp, home) in which it met a set that looks similar."""
    for g in grouped(batches, 3):
        if g.num_rows < 2:
            continue
        ids, grp, home, found = g.column(5).to_numpy(), g.column(7).to_numpy(), g.column(8).to_numpy(), set()
        for p, rest, alike in _alike(g, low):
            near = alike(rest[grp[rest] == grp[p]])
            found.update((int(ids[p]), int(x)) for x in np.unique(home[near]))
            found.update((int(x), int(home[p])) for x in ids[near])
        if found:
            rep, other = np.array(sorted(found), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(other.astype(np.int32))], names=["rep", "other"])


def _split_rows(batches, tuples: list[int], small: int):
    """Of each block (path, side, rep, data, m, used) of a large bucket: (rep, path, true, null, m, 0) for dense sets, and (rep, path, false, longer path, m, used) for others, which go on."""
    for g in grouped(batches, 2):
        tokens, m, whole = _sketches(g.column(3)), g.num_rows, g.column(4)[0].as_py()
        agree = np.zeros(m)
        for c in range(SLOTS):  # blocks are dealt by hash, so a block shows what the bucket is like
            _, which, count = np.unique(tokens[:, c], return_inverse=True, return_counts=True)
            agree += count[which]
        dense = agree / (SLOTS * m) >= DENSE
        path, rep = g.column(0)[0].as_py(), g.column(2).to_numpy()
        depth = min(depth_of(whole, small), len(tuples))
        child, used = go_on(tokens[~dense], path, g.column(5)[0].as_py(), depth, tuples[depth - 1])
        n, stay = child.size, int(dense.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rep[dense], np.tile(rep[~dense], len(child))])), pa.array(np.full(stay + n, path)), pa.array(np.arange(stay + n) < stay),
             pa.array(np.concatenate([np.zeros(stay, np.int64), child.ravel()]), mask=np.arange(stay + n) < stay), pa.array(np.full(stay + n, whole)), pa.array(np.concatenate([np.zeros(stay, np.int64), used.ravel()]))],
            names=["rep", "path", "dense", "child", "m", "used"],
        )


def candidate_edges(sets: DataFrame, threshold: float, recall: float, work: Work) -> tuple[DataFrame, DataFrame]:
    """(src, dst) edges between sets (rep, data) that met and look similar, and the rows (rep, path, dense, m) of the buckets where sets were compared."""
    low = least_slots(recall, threshold) / SLOTS
    runs = runs_needed(recall, threshold)

    def start(batches):
        for b in batches:
            if b.num_rows:
                ids, tokens = b.column(0).to_numpy(), _sketches(b.column(1))
                for r in range(runs):
                    row, path, used = choose(tokens, r + 1, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(path), pa.array(used)], names=["rep", "path", "used"])

    sketches, edges, compared, level, tuples, small = sets.select("rep", "data"), [], [], 0, None, SMALL
    rows = sketches.mapInArrow(start, "rep long, path long, used long")
    while True:
        rows = work.save(rows, f"paths-{level}")
        sizes = work.save(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), f"sizes-{level}")
        largest, total = sizes.agg(F.max("m"), F.sum("m")).first()
        more, total = (largest or 0) > small, total or 0
        placed = work.save(rows.join(sizes, "path"), f"placed-{level}", tasks(total))  # written tables: hot paths are split at run time
        few = placed.where(F.col("m") <= small).select("rep", "path", F.lit(True).alias("dense"), "m")
        if more:
            many = placed.where(F.col("m") > small).withColumn("side", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / LOOK)).cast("int"))
            if tuples is None:  # a round more than buckets need on average
                rounds = math.ceil(depth_of(largest, small) / DEPTH) + 1
                tuples = [tuples_needed(d + 1, rounds, recall, threshold) for d in range(DEPTH)]
            many = many.join(sketches, "rep").select("path", "side", "rep", "data", "m", "used").repartition("path", "side").sortWithinPartitions("path", "side")
            split = work.save(many.mapInArrow(lambda it: _split_rows(it, tuples, small), "rep long, path long, dense boolean, child long, m long, used long"), f"split-{level}", tasks(total, 1000))
            dense = split.where("dense").select("rep", "path", "dense")
            whole = placed.where(F.col("m") > small).select("rep", "path", "m").join(dense.select("path").distinct(), "path", "left_semi")
            whole = whole.join(dense, ["rep", "path"], "left").select("rep", "path", F.coalesce("dense", F.lit(False)).alias("dense"), "m")
            few = few.unionByName(work.save(whole, f"whole-{level}", tasks(total)))
        compared.append(few)
        edges.append(work.save(_blocks(few, sketches).mapInArrow(lambda it: _forest_rows(it, low), "src long, dst long"), f"edges-{level}", tasks(total, 1000)))
        if not more:
            return functools.reduce(DataFrame.unionByName, edges), functools.reduce(DataFrame.unionByName, compared)
        rows = split.where("child is not null").select("rep", F.col("child").alias("path"), "used")
        sketches = work.save(sketches.join(rows.select("rep").distinct(), "rep", "left_semi"), f"alive-{level}", tasks(total))
        level += 1


def group_blocks(group: DataFrame, sets: DataFrame, compared: DataFrame, threshold: float, recall: float, work: Work) -> DataFrame:
    """(rep, grp, side, i, j): the block pairs in which a group's sets are compared exactly."""
    low = least_slots(recall, threshold) / SLOTS
    sizes = work.save(group.groupBy("grp").agg(F.count("*").alias("m")), "group-sizes")
    zero, wide = F.lit(0), (sizes.agg(F.max("m")).first()[0] or 0) > BLOCK
    if not wide:
        return group.select("rep", "grp", zero.alias("side"), zero.alias("i"), zero.alias("j"))
    placed = group.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = work.save(placed.select("rep", "grp", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("home")), "placed-groups")
    out = placed.where("blocks = 1").select("rep", "grp", zero.alias("side"), zero.alias("i"), zero.alias("j"))
    wide = placed.where("blocks > 1").select("rep", "grp", "home")
    dealt = _blocks(compared.join(wide.select("rep"), "rep", "left_semi"), sets.select("rep", "data").join(wide, "rep"))
    met = work.save(dealt.mapInArrow(lambda it: _met_rows(it, low), "rep long, other int").distinct(), "met")
    far = met.join(wide, "rep").select("rep", "grp", F.col("home").alias("side"), F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))
    return out.unionByName(far.distinct())


def _exact(batches, threshold: float):
    """Links of each candidate group, or block pair of one, by exact Jaccard similarity."""
    for g in grouped(batches, 3):
        m, i, j = g.num_rows, g.column(1)[0].as_py(), g.column(2)[0].as_py()
        if m < 2:
            continue
        side, rep, mult, n = (g.column(k).to_numpy() for k in (3, 4, 5, 6))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if not len(left) or not len(right):
            continue
        blobs = g.column(7).to_pylist()
        value = np.frombuffer(b"".join(blobs), np.uint64)
        owner = np.repeat(np.arange(m), n)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        token = np.cumsum(new) - 1
        often = np.bincount(token)[token] > 1
        token, owner = np.unique(token[often], return_inverse=True)[1] if often.any() else token[often], owner[often]
        width = int(token.max()) + 1 if len(token) else 0
        shared = np.zeros((len(left), len(right)), np.float32)
        a_at, b_at = np.full(m, -1), np.full(m, -1)
        a_at[left], b_at[right] = np.arange(len(left)), np.arange(len(right))
        bounds = np.searchsorted(token, np.arange(0, width + 4096, 4096))  # sorted, as values were
        for lo, hi, base in zip(bounds, bounds[1:], range(0, width + 4096, 4096)):
            t, o = token[lo:hi] - base, owner[lo:hi]
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            x[a_at[o[a_at[o] >= 0]], t[a_at[o] >= 0]] = 1
            y[b_at[o[b_at[o] >= 0]], t[b_at[o] >= 0]] = 1
            shared += x @ y.T
        both = n[left][:, None] + n[right][None, :] - shared
        a, b = np.nonzero(shared >= threshold * both - 1e-9 * both)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
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


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999, work: Work | None = None) -> DataFrame:
    """(id, class_id, n_links, class_key, row_key, kept): one row a document.

    Linked documents have Jaccard similarity >= ``threshold`` of their sets of
    ``width``-word shingles; class_id is the smallest id reachable by links.  A
    document of fewer words has one shingle of all of them.  Null texts and texts
    without a word link with nothing.  Documents with equal sets link with each other
    and share all other links; repeated rows are copies.  Rows with a null id
    are alone.  Rows of one id with different texts are documents of their own;
    ``class_key`` tells classes apart even then (null: alone), and ``row_key`` rows.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "chosen-path")
    rows = work.save(sets_of(docs, id_col, text_col, width, True), "sketches")
    full = rows.where("n > 0 and id is not null")
    sets = full.groupBy("d1", "d2", "n").agg(F.min("id").alias("low"), F.count("*").alias("mult"), F.min("data").alias("data"))
    sets = work.save(sets.withColumn("rep", F.xxhash64("d1", "d2", "n")), "sets")
    edges, compared = candidate_edges(sets, threshold, recall, work)
    group = work.save(components(edges, work, "candidates"), "groups").select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    blocks = work.save(group_blocks(group, sets, compared, threshold, recall, work), "blocks")
    wanted = sets.select("rep", "low", "mult").join(group.select("rep"), "rep")
    some = semi_reduce(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", wanted.select("low"))
    members = sets_of(some, "id", "text", width, False).select(F.xxhash64("d1", "d2", "n").alias("rep"), "n", "data").dropDuplicates(["rep"])
    dealt = blocks.join(members.join(wanted.select("rep", "mult"), "rep"), "rep").select("grp", "i", "j", "side", "rep", "mult", "n", "data")
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = work.save(dealt.mapInArrow(lambda it: _exact(it, threshold), "src long, dst long, n long"), "found")
    label = work.save(components(found.where("dst is not null").select("src", "dst"), work, "classes").withColumnRenamed("id", "rep"), "labels")
    counts = found.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n_links"))
    per = sets.select("d1", "d2", "n", "rep", "low", "mult").join(counts, "rep", "left").join(label, "rep", "left").withColumn("class_key", F.coalesce("component", "rep"))
    per = work.save(per, "per")
    lowest = work.save(per.groupBy("class_key").agg(F.min("low").alias("class_low")), "lowest")
    per = per.join(lowest, "class_key").select("d1", "d2", "n", "class_key", "mult", (F.coalesce("n_links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.col("class_low").alias("class_id"))
    per = work.save(per, "classes-of-sets")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    rows = rows.drop("data")
    out = rows.where(~alone).join(per, ["d1", "d2", "n"]).select("id", "class_id", "n_links", "class_key", "row_key")
    lone = rows.where(alone).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class_key"), "row_key")
    return out.unionByName(lone).withColumnRenamed("id", id_col).withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))
