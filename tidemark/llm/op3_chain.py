"""Toxicity by a chain of linear classifiers.

The label columns are predicted one after another.  Each model is a logistic
regression on words and word beginnings (hashed, chosen by information) and on
the probabilities of all earlier labels; in training these are out-of-fold
predictions, so a later model sees earlier ones as good as they are on new text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, ship_package, slices, small
from .op1_langid import char_classes
from .words import mix, word_hashes

#: Columns of the feature space, and how many of them a model uses.
SPACE, CHOSEN = 1 << 20, 20_000
FOLDS = 3
PREFIXES = (4, 5, 6)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): the distinct words and their beginnings, hashed, in order of texts."""
    u = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts], np.int64) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    letter = np.concatenate([[False], char_classes()[u] > 0, [False]])
    start, end = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(at, start, side="right") - 1
    codes = [mix(word_hashes(u, start, end if n is None else np.minimum(end, start + n)) + np.uint64(n or 0)) for n in (None, *PREFIXES)]
    key = np.unique(np.concatenate([doc] * (1 + len(PREFIXES))) * SPACE + (np.concatenate(codes) % np.uint64(SPACE)).astype(np.int64))
    return key // SPACE, key % SPACE


@dataclass
class Linear:
    weights: np.ndarray  # SPACE
    extra: np.ndarray  # one for each earlier label
    bias: float

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(doc, self.weights[feature], n) + earlier @ self.extra + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(doc: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 0.3, steps: int = 150) -> Linear:
    """Logistic regression on the rows marked in ``rows``: accelerated gradient descent."""
    use = rows[doc]
    d, f = doc[use], feature[use]
    total, share = int(rows.sum()), float(y[rows].mean()) if rows.any() else 0.0
    weights = np.zeros(SPACE, np.float32)
    if not total or share in (0.0, 1.0):
        return Linear(weights, np.zeros(earlier.shape[1]), -6.0 if share == 0 else 6.0)
    seen = np.bincount(f, minlength=SPACE).astype(np.float64)
    hits = np.bincount(f, y[d], SPACE)
    rate = np.clip(hits / np.maximum(seen, 1), 1e-12, 1 - 1e-12)
    told = seen * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))  # bounds the binomial tail
    told[seen < 3] = 0
    least = np.log((seen >= 3).sum() + 1) + 1  # chance gives so much to a third of one feature
    chosen = np.sort(np.argsort(-told, kind="stable")[: min(CHOSEN, int((told >= least).sum()))])
    column = np.full(SPACE, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[f] >= 0
    at = np.cumsum(rows) - 1
    i, j, m, k = at[d[keep]], column[f[keep]], len(chosen), earlier.shape[1]
    x, t = np.hstack([earlier[rows], np.ones((total, 1))]), y[rows].astype(float)
    # columns of unit length: rare and frequent words learn equally fast
    scale = 1 / np.sqrt(np.concatenate([np.maximum(np.bincount(j, minlength=m), 1), np.maximum((x * x).sum(0), 1e-9)]))

    def forward(w):
        w = w * scale
        return np.bincount(i, w[j], total) + x @ w[m:]

    def back(r):
        return np.concatenate([np.bincount(j, r[i], m), x.T @ r]) * scale

    v = np.ones(m + k + 1)
    for _ in range(8):
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    penalty = ridge * scale**2
    penalty[-1] = 0
    step = 1 / (0.25 * size * 1.1 + penalty.max())
    w, old = np.zeros(m + k + 1), np.zeros(m + k + 1)
    for s in range(steps):
        look = w + s / (s + 3) * (w - old)
        g = back(1 / (1 + np.exp(-np.clip(forward(look), -30, 30))) - t)
        old, w = w, look - step * (g + penalty * look)
    w = w * scale
    weights[chosen] = w[:m]
    return Linear(weights, w[m:-1], float(w[-1]))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    labels: list[str]
    models: list[Linear]
    cut: list[float]

    def predict(self, texts: list[str]) -> np.ndarray:
        doc, feature = features(texts)
        earlier = np.zeros((len(texts), 0))
        out = []
        for m in self.models:
            out.append(m.score(doc, feature, len(texts), earlier))
            earlier = np.hstack([earlier, logit(out[-1])[:, None]])
        return np.stack(out, 1)


def train(docs: DataFrame, labels: DataFrame, columns: list[str], target: str, per_class: int = 4000) -> Chain | None:
    """Fits on at most ``per_class`` labelled documents with and without ``target``, those with the lowest id hash.

    Rows with a null id or a null label are left out; of repeated label rows the
    highest labels count, and every document row of a labelled id is a row to learn
    from.  Folds go by text, so copies of a text are never on both sides of one.
    Texts are read whole, however long; other columns are ignored.  None if no
    labelled document is left.
    """
    ship_package(docs.sparkSession)
    good = labels.select("doc_id", *[F.col(c).cast("int") for c in columns]).where(" and ".join(f"{c} is not null" for c in ["doc_id", *columns]))
    good = good.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns]).withColumn("h", F.xxhash64("doc_id"))
    counts = {r[target]: r["n"] for r in good.groupBy(target).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    picked = None
    for k in sorted(counts):
        part = good.where(F.col(target) == k).orderBy("h").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(small(picked.drop("h"), 2 * per_class), "doc_id").where("text is not null")

    def run(batches):
        for b in slices(batches, 1):
            d, f = features(b.column(1).to_pylist())
            n = np.bincount(d, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), binary_column(f.astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(4 * n)])), b.column(2), *[b.column(3 + i) for i in range(len(columns))]], names=["doc_id", "f", "copy", *columns]
            )

    found = rows.select("doc_id", "text", F.xxhash64("text").alias("copy"), *columns).mapInArrow(run, "doc_id long, f binary, copy long, " + ", ".join(f"{c} int" for c in columns)).collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r["doc_id"], r["f"]))
    n = len(found)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r["f"]) // 4 for r in found])
    feature = np.frombuffer(b"".join(r["f"] for r in found), "<i4")
    fold = mix(np.array([r["copy"] for r in found], np.int64).view(np.uint64)) % np.uint64(FOLDS)
    weight = np.array([max(1.0, counts[r[target]] / per_class) for r in found])
    known = {c: np.array([r[c] for r in found], float) for c in columns}
    del found
    earlier, models, cuts = np.zeros((n, 0)), [], []
    for c in columns:
        y = known[c]
        out = np.zeros(n)
        for k in range(FOLDS):
            test = fold == k
            out[test] = fit(doc, feature, n, earlier, y, ~test).score(doc, feature, n, earlier)[test]
        models.append(fit(doc, feature, n, earlier, y, np.ones(n, bool)))
        cuts.append(best_cut(out, y, weight))
        earlier = np.hstack([earlier, logit(out)[:, None]])
    return Chain(columns, models, cuts)


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which on out-of-fold F1, weighted to the whole table, is highest.

    Equal probabilities stay together, and at least half of what lies above must
    be right; where no cut does that (too few labels to learn from), nothing lies above.
    """
    order = np.argsort(-p, kind="stable")
    hit, above = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    last = np.concatenate([p[order][1:] < p[order][:-1], [True]])
    score = np.where(last & (hit >= above / 2), 2 * hit / (above + max(1e-9, float((y * weight).sum()))), 0)
    i = int(np.argmax(score))
    if score[i] <= 0:
        return 2.0
    low = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[order[i]] + low) / 2)


def score(docs: DataFrame, chain: Chain | None, target: str) -> DataFrame:
    """(doc_id, p_<label>..., <target> boolean) of every whole text.

    Null and empty texts are never ``target``; a probability that ties with the
    cut is.  Repeated rows repeat, null ids stay null, other columns are ignored,
    and an empty table gives no rows; without a chain all probabilities are null
    and nothing is ``target``.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # SPACE weights a label
    columns = chain.labels if chain else [target]

    def run(batches):
        c = shared.value
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            if c:
                p = c.predict(texts)
                i = c.labels.index(target)
                flag = [bool(x) and bool(q >= c.cut[i]) for x, q in zip(texts, p[:, i])]
                cols = [pa.array(p[:, k]) for k in range(len(columns))]
            else:
                flag, cols = [False] * len(texts), [pa.nulls(len(texts), pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(flag)], names=["doc_id", *[f"p_{x}" for x in columns], target])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{x} double" for x in columns) + f", {target} boolean")
