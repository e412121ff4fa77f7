"""Sharding: k-d tree partitioning by distributed weighted medians, in DataFrame operations only.

Documents with equal texts form one point; its coordinates are metadata of the
group's first document (code points, source, language, id) and its weight is
the bytes of all its copies.  Nodes split at the weighted median along their
widest dimension until leaves reach the target bytes.  A median is found by
refining histograms (at most ``BINS`` rows a node each pass), never by sorting
or collecting points; only one row a node reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work, small

BINS = 4096
#: Bits of the tie-breaking coordinate that orders points with equal values.
TIE = 24
DIMS = ("d0", "d1", "d2", "d3")
#: A group heavier than this part of a leaf is dealt to a leaf first; there are at most leaves / HEAVY of them.
HEAVY = 0.02


def points(docs: DataFrame) -> DataFrame:
    """One row a document: id, a number of its own, wide hash of its text, size (UTF-8 bytes + 1), crc32 and the coordinates.

    Null text counts as a group of its own with size 1; null metadata is 0.  The
    numbers are fixed only once the rows are written.
    """
    text = F.col("text")
    whole = F.coalesce(text, F.lit(""))
    code = lambda c: F.coalesce((F.xxhash64(c) % 65536 + 65536) % 65536, F.lit(0))
    return docs.select(
        F.col("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.lit(1), text.isNull(), whole).alias("h1"),
        F.xxhash64(F.lit(2), whole, F.length(whole)).alias("h2"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long")).alias("d0"),
        code(F.col("source")).alias("d1"),
        code(F.col("lang")).alias("d2"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d3"),
    )


def _medians(state: DataFrame, cuts: list[dict]) -> list[dict]:
    """For each open node, refine (lo, hi) of its dimension until one value is left; ``below`` is the weight left of it."""
    spark = state.sparkSession
    while any(c["hi"] > c["lo"] for c in cuts):
        rows = [(c["node"], c["dim"], c["lo"], c["hi"], (c["hi"] - c["lo"]) // BINS + 1, c["goal"] - c["below"], c["value"]) for c in cuts]
        open_ = small(spark.createDataFrame(rows, "node int, dim int, lo long, hi long, step long, goal double, value long"), len(rows))
        joined = state.join(open_, "node").withColumn("x", _pick("dim", "value")).where("x between lo and hi")
        bins = joined.groupBy("node", F.expr("(x - lo) div step").alias("bin")).agg(F.sum("w").alias("w"), F.first("goal").alias("goal"))
        run = bins.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
        hit = run.groupBy("node").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "upto", "w"))), F.max(F.struct("bin", "upto", "w"))).alias("b")
        )
        found = {r["node"]: r["b"] for r in hit.collect()}  # one row a node
        for c in cuts:
            if c["hi"] > c["lo"]:
                b = found.get(c["node"])
                if b is None:  # no point in reach
                    c["hi"] = c["lo"]
                    continue
                step = (c["hi"] - c["lo"]) // BINS + 1
                c["below"] += b["upto"] - b["w"]
                c["at"] = b["w"]
                c["lo"] = c["lo"] + b["bin"] * step
                c["hi"] = min(c["hi"], c["lo"] + step - 1)
    return cuts


def _pick(dim: str, value: str) -> Column:
    """The chosen coordinate; where ``value`` is set, the tie coordinate of points at that value."""
    own = F.element_at(F.array(*DIMS), F.col(dim) + 1)
    return F.when(F.col(value).isNull(), own).when(own == F.col(value), F.col("tie"))


def kd_leaves(groups: DataFrame, shares: list[float], work: Work) -> DataFrame:
    """``groups`` (g1, g2, w, d0..d3) with ``leaf`` 0..len(shares)-1, leaves weighing about their shares (bytes).

    Splits reach exactly one leaf a share; a share of 0 leaves an empty leaf.
    """
    spark = groups.sparkSession
    state = groups.withColumn("tie", F.pmod(F.xxhash64("g1", "g2"), F.lit(1 << TIE))).withColumn("node", F.lit(1))
    spans = {1: (0, len(shares))}  # node -> its leaves
    level = 0
    ranges = state.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).first()
    if ranges["min_d0"] is None:
        return state.withColumn("leaf", F.lit(0))
    whole = {d: max(1, ranges[f"max_{d}"] - ranges[f"min_{d}"]) for d in DIMS}
    while any(b - a > 1 for a, b in spans.values()):
        stats = {r["node"]: r for r in state.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).collect()}
        cuts = []
        for node, (a, b) in spans.items():
            if b - a < 2 or node not in stats:
                continue
            s, mid, total = stats[node], (a + b) // 2, sum(shares[a:b])
            dim = max(range(len(DIMS)), key=lambda i: (s[f"max_{DIMS[i]}"] - s[f"min_{DIMS[i]}"]) / whole[DIMS[i]])
            goal = float(s["w"]) * (sum(shares[a:mid]) / total if total > 0 else 0.5)
            cuts.append({"node": node, "dim": dim, "lo": s[f"min_{DIMS[dim]}"], "hi": s[f"max_{DIMS[dim]}"], "goal": goal, "below": 0.0, "value": None, "at": 0.0})
        for c in _medians(state, cuts):  # then among the points at that value
            c |= {"value": c["lo"], "lo": 0, "hi": (1 << TIE) - 1}
        _medians(state, cuts)
        rows = []
        for c in cuts:
            nearer = abs(c["below"] + c["at"] - c["goal"]) <= abs(c["below"] - c["goal"])
            rows.append((c["node"], c["dim"], c["value"], c["lo"] if nearer else c["lo"] - 1))
        table = small(spark.createDataFrame(rows, "node int, dim int, value long, cut long"), len(rows))
        own = F.element_at(F.array(*DIMS), F.col("dim") + 1)
        left = (own < F.col("value")) | ((own == F.col("value")) & (F.col("tie") <= F.col("cut")))
        state = state.join(table, "node", "left").withColumn(
            "node", F.when(F.col("dim").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
        ).drop("dim", "value", "cut")
        state = work.save(state, f"kd-{level}")
        if level:
            work.drop(f"kd-{level - 1}")
        level += 1
        halves = {}
        for node, (a, b) in spans.items():
            halves |= {2 * node: (a, (a + b) // 2), 2 * node + 1: ((a + b) // 2, b)} if b - a > 1 else {2 * node: (a, b)}
        spans = halves
    leaf = small(spark.createDataFrame([(n, a) for n, (a, _) in spans.items()], "node int, leaf int"), len(spans))
    return state.join(leaf, "node").drop("node", "tie")


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, work: Work | None = None) -> DataFrame:
    """Documents (doc_id, text, lang, source) as (doc_id, row, size, text_crc32, shard), shards of near equal bytes.

    Give the number of shards, or the bytes a shard should have.  Equal texts
    share a shard unless their group alone exceeds half a shard, whose rows are
    then dealt one by one, by a number of their own, so repeated and null ids do
    not matter.  Null or empty texts have size 1; null metadata counts as 0;
    repeated rows are rows of their own; points with equal coordinates (ties) are
    ordered by their hash; other columns are ignored; an empty table has no rows.
    """
    work = work or Work(docs.sparkSession, "kdtree")
    rows = work.save(points(docs), "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    target = total / n_shards
    sums = rows.groupBy("h1", "h2").agg(
        F.sum("size").alias("w"), F.min(F.struct("d3", "d0", "d1", "d2")).alias("d")
    ).select("h1", "h2", "w", "d.*")
    sums = work.save(sums, "groups")
    # groups over half a shard are at most 2 * n_shards; their rows become points of their own
    big = small(sums.where(F.col("w") > target / 2).select("h1", "h2", F.lit(True).alias("loose")), 2 * n_shards)
    own = lambda h: F.when(F.col("loose"), F.xxhash64(h, "row")).otherwise(F.col(h))
    rows = work.save(rows.join(big, ["h1", "h2"], "left").withColumn("g1", own("h1")).withColumn("g2", own("h2")), "keyed")
    one = sums.join(big, ["h1", "h2"], "left_anti").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "w", *DIMS)
    each = rows.where("loose").select("g1", "g2", F.col("size").alias("w"), *DIMS)
    groups = work.save(one.unionByName(each), "units")
    heavy = sorted(groups.where(F.col("w") > HEAVY * target).select("g1", "g2", "w").collect(), key=lambda r: (-r["w"], r["g1"], r["g2"])) if total else []
    room, placed = [(-target, i) for i in range(n_shards)], []
    for r in heavy:  # n_shards / HEAVY rows at most
        free, leaf = heapq.heappop(room)
        heapq.heappush(room, (free + r["w"], leaf))
        placed.append((r["g1"], r["g2"], leaf))
    first = small(docs.sparkSession.createDataFrame(placed, "g1 long, g2 long, leaf int"), len(placed))
    left = [-free for free, _ in sorted(room, key=lambda x: x[1])]
    light = kd_leaves(groups.join(first, ["g1", "g2"], "left_anti"), [max(0.0, x) for x in left], work)
    # rows of heavy groups find their leaf without a shuffle; the others are at most HEAVY of a shard each
    known = rows.join(first, ["g1", "g2"], "left").select("doc_id", "row", "size", "text_crc32", "g1", "g2", "leaf")
    found = known.where("leaf is null").drop("leaf").join(light.select("g1", "g2", "leaf"), ["g1", "g2"])
    return known.where("leaf is not null").unionByName(found).select("doc_id", "row", "size", "text_crc32", F.col("leaf").alias("shard"))


def slots(assigned: DataFrame, work: Work, rows_a_cell: int = 20_000) -> DataFrame:
    """``slot``: gapless from 0 in each shard.

    Rows are numbered in cells of about ``rows_a_cell``, dealt by the rows' own
    numbers so that repeated ids share no cell, and cells start where the one before ends.
    """
    assigned = work.save(assigned, "assigned-rows")
    counts = {r["shard"]: r["n"] for r in assigned.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    n_cells = max(1, -(-max(counts.values(), default=0) // rows_a_cell))
    rows = assigned.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(n_cells)).cast("int"))
    base = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    base = base.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    rank = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "row")) - 1
    return rows.withColumn("rank", rank).join(small(base, n_cells * len(counts)), ["shard", "cell"]).withColumn("slot", (F.col("base") + F.col("rank")).cast("long")).drop("cell", "rank", "base", "row")
