"""Mixing sources to target weights by balanced (cube-method) sampling.

A source whose target is r times its size is taken floor(r) times whole; each
of its documents is taken once more with probability r - floor(r).  Those
fractional probabilities move through the null space of two constraints (words
and documents taken) until all but a few are 0 or 1.  This runs in blocks of
each source; the few undecided documents of all blocks meet in the next round,
and the last two or so of a source are decided by the combination nearest to
the target (landing).
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Work, small

#: Documents of a source that one task balances at once.
BLOCK = 2_500


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> dict[str | None, float]:
    """Words each source should give: weights in code point order (null last), at most ``most`` times a source's size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, goal, free = Fraction(share) * sum(sizes.values()), {}, list(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > most * sizes[s] * whole]
        if not over:
            goal |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            goal[s] = Fraction(most * sizes[s])
        left -= sum(goal[s] for s in over)
        free = [s for s in free if s not in goal]
    return {s: float(goal[s]) for s in order}


def flight(size: list[int], pi: list[float], seed: int) -> list[float]:
    """Flight phase: at most two entries (three if no step exists) stay strictly between 0 and 1."""
    rng, eps, n = random.Random(seed), 1e-9, len(size)
    active, nxt = [], 0
    while True:
        while len(active) < 3 and nxt < n:
            if eps < pi[nxt] < 1 - eps:
                active.append(nxt)
            nxt += 1
        if len(active) == 3:
            i, j, k = active
            u = (size[j] - size[k], size[k] - size[i], size[i] - size[j])  # orthogonal to sizes and to ones
            if u == (0, 0, 0):
                u = (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return pi
        up = down = float("inf")
        for a, d in zip(active, u):
            p = pi[a]
            if d > 0:
                up, down = min(up, (1 - p) / d), min(down, p / d)
            elif d < 0:
                up, down = min(up, p / -d), min(down, (1 - p) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for a, d in zip(active, u):
            p = pi[a] + step * d
            pi[a] = 0.0 if p < eps else 1.0 if p > 1 - eps else p
        active = [a for a in active if 0.0 < pi[a] < 1.0]


def large_first(size: list[int], pi: list[float], seed: int, most: int = 64) -> list[float]:
    """Decides the largest entries (``most``, half of all at most) while every smaller one moves a little.

    Three at a time, the flight would keep large entries undecided to the end.
    Here the move is 1 for the large entry and a + b * size for the others, with
    a and b such that words and documents stay as they are (words alone, where
    all others have one size).
    """
    rng, s, p = random.Random(seed), np.array(size, float), np.array(pi, float)
    order = np.argsort(-s, kind="stable")
    eps = 1e-9
    for k in range(min(most, len(order) // 2)):
        i = order[k]
        while eps < p[i] < 1 - eps:
            rest = order[k + 1 :]
            rest = rest[(p[rest] > eps) & (p[rest] < 1 - eps)]
            if len(rest) < 3:
                break
            x, n = s[rest], len(rest)
            one, two = x.sum(), (x * x).sum()
            det = n * two - one * one
            if det > 1e-9 * n * two:
                a, b = (-two + s[i] * one) / det, (-n * s[i] + one) / det
            else:
                a, b = (-s[i] / one if one else -1 / n), 0.0
            u = np.concatenate([[1.0], a + b * x])
            q = np.concatenate([[p[i]], p[rest]])
            with np.errstate(divide="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, q / -u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (1 - q) / -u, np.inf)).min()
            q = q + (up if rng.random() * (up + down) < down else -down) * u
            p[i], p[rest] = q[0], q[1:]
        p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    return p.tolist()


def landing(size: list[int], pi: list[float]) -> list[float]:
    """Decides the undecided few (at most three) by the combination whose words, then documents, are nearest to expected."""
    rest = [i for i, p in enumerate(pi) if 0.0 < p < 1.0]
    best = min(
        range(1 << len(rest)),
        key=lambda m: (abs(sum(size[i] * ((m >> b & 1) - pi[i]) for b, i in enumerate(rest))), abs(sum((m >> b & 1) - pi[i] for b, i in enumerate(rest))), m),
        default=0,
    )
    for b, i in enumerate(rest):
        pi[i] = float(best >> b & 1)
    return pi


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable", na_position="last")
    size, pi = pdf["size"].tolist(), pdf["pi"].tolist()
    seed = len(size) * 1_000_003 + sum(size)
    pi = flight(size, large_first(size, pi, seed), seed + 1)
    if pdf["last"].iloc[0]:
        pi = landing(size, pi)
    return pdf.assign(pi=pi).drop(columns="blocks")


def row_hash():
    """Tells rows with one id apart; equal rows agree."""
    return F.xxhash64("doc_id", F.lit(4), "text", "source")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, work: Work | None = None) -> DataFrame:
    """Documents as (doc_id, source, size, source_size, target, copies, h): how often the mix takes each; h is the row's hash.

    Null text has size 0; documents of size 0 are taken as often as their
    source is taken whole.  Null sources are one source, last in order.  Equal
    rows are rows of their own.  An empty table gives no rows.  Reruns agree.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "cube")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = work.save(docs.select("doc_id", "source", words.alias("size"), row_hash().alias("h")), "sized")
    counts = {r["source"]: (r["s"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}  # one row a source
    goal = targets({s: x[0] for s, x in counts.items()}, weights, share, most)
    rows = []
    for s, (size, n) in counts.items():
        r = goal[s] / size if size else 0.0
        rows.append((s, size, goal[s], int(r + 1e-12), max(0.0, r - int(r + 1e-12)), max(1, -(-n // BLOCK))))
    plan = small(spark.createDataFrame(rows, "p_source string, source_size long, target double, base int, pi double, blocks int"), len(rows))
    state = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    schema = "doc_id long, source string, size long, h long, source_size long, target double, base int, pi double, block long, last boolean"
    done, n = [state.where("pi < 1e-9").drop("blocks")], 0
    state = state.where("pi >= 1e-9")
    most_blocks = max((r[5] for r in rows), default=1)
    while True:
        dealt = state.withColumn("block", F.pmod("h", F.col("blocks")).cast("long")).withColumn("last", F.col("blocks") == 1)
        out = work.save(dealt.groupBy("source", "block").applyInPandas(_round, schema).drop("block", "last"), f"round-{n}")
        done.append(out.where("pi = 0 or pi = 1"))
        if most_blocks == 1:
            break
        n += 1
        # two undecided documents a block go on
        state = out.where("pi > 0 and pi < 1").join(plan.select("p_source", "blocks"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
        state = state.withColumn("blocks", F.ceil(F.col("blocks") * (3.0 / BLOCK) ** n).cast("int"))
        most_blocks = -(-most_blocks * 3 // BLOCK)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("pi").cast("int")).alias("copies"), "h")
