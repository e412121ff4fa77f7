"""Language ID with string kernels.

The kernel of two texts is the number of character n-grams (n = 1..3, the
blended spectrum) present in both, normalised by each text's own count.  It is
approximated by Nystroem features from landmark texts; one ridge regression a
language (one versus the rest) is solved in closed form, and texts are scored
in batches by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import Work, list_column, ship_package, slices, small

UNKNOWN = "und"
LETTERS = 64
SPACE = 1 + LETTERS + LETTERS**2 + LETTERS**3
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: 0 for what is no letter, 1..26 for a to z, the others hashed to 27..63, case folded."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 13) % 37
        _classes.append(table)
    return _classes[0]


def grams(texts: list[str]):
    """For each text the distinct n-gram codes present in it; none if it has no letter."""
    table = char_classes()
    stamp = np.zeros(SPACE, np.int32)
    for text in texts:
        c = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        if not c.any():
            yield np.zeros(0, np.int32)
            continue
        c = np.pad(c, 1)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one boundary for a run of others
        two = c[:-1] * LETTERS + c[1:]
        codes = np.concatenate([1 + c, 1 + LETTERS + two, 1 + LETTERS + LETTERS**2 + two[:-1] * LETTERS + c[2:]])
        at = np.arange(len(codes), dtype=np.int32)
        stamp[codes] = at
        yield codes[stamp[codes] == at]


@dataclass
class Model:
    labels: list[str]
    lookup: np.ndarray  # gram code -> row of ``landmarks``, or -1
    landmarks: np.ndarray  # grams x landmarks, scaled by the landmarks' norms
    root: np.ndarray  # landmarks x features: inverse root of their kernel
    weights: np.ndarray | None  # features + 1 x labels

    def features(self, texts: list[str], batch: int = 128):
        """(rows of ``texts`` with a letter, their features), a batch at a time."""
        rows, dense, norms = [], np.zeros((batch, self.landmarks.shape[0]), np.float32), []
        for i, g in enumerate(grams(texts)):
            if len(g):
                hit = self.lookup[g]
                dense[len(rows), hit[hit >= 0]] = 1
                rows.append(i)
                norms.append(len(g))
            if len(rows) == batch:
                yield rows, self._features(dense, norms)
                rows, norms = [], []
                dense[:] = 0
        if rows:
            yield rows, self._features(dense[: len(rows)], norms)

    def _features(self, dense: np.ndarray, norms: list[int]) -> np.ndarray:
        kernel = (dense @ self.landmarks) / np.sqrt(np.array(norms, np.float32))[:, None]
        return np.hstack([kernel @ self.root, np.ones((len(norms), 1), np.float32)])


def _grams_of(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches, 1):
            found = list(grams(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(np.concatenate(found), np.array([len(x) for x in found]))], names=["lang", "grams"])

    return df.mapInArrow(run, "lang string, grams array<int>")


def train(labelled: DataFrame, work: Work, per_label: int = 400, landmarks_per_label: int = 32, ridge: float = 1e-3) -> Model | None:
    """Fits on at most ``per_label`` distinct texts (lang, text) of each language, those with the lowest text hash.

    Null languages and texts without a letter are left out; None if nothing is left.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(1), "text").alias("h"))
    share = (F.col("h") / F.lit(2.0**64)) + 0.5
    keys = work.save(rows.select("lang", "h").distinct(), "train-keys")
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    spark = labelled.sparkSession

    def lowest(rate: dict[str, float], name: str) -> DataFrame:
        """The lowest hashes (lang, h, k) among the given share of each language's."""
        rates = small(spark.createDataFrame(sorted(rate.items()), "lang string, rate double"), len(rate))
        ranked = keys.join(rates, "lang").where(share < F.col("rate")).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h")))
        return work.save(ranked.where(F.col("k") <= per_label).select("lang", "h", "k"), name)

    chosen = lowest({k: min(1.0, 4.0 * per_label / n) for k, n in counts.items()}, "train-chosen")
    have = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    short = [k for k, n in counts.items() if have.get(k, 0) < min(per_label, n)]
    if short:  # hashes so uneven that the share held too few: rank all of them
        again = lowest(dict.fromkeys(short, 2.0), "train-short")
        chosen = chosen.where(~F.col("lang").isin(short)).unionByName(again)
    few = rows.join(small(chosen, per_label * len(counts)), ["lang", "h"]).dropDuplicates(["lang", "h"])
    few = work.save(few.select("lang", "text", "k"), "train")
    found = [(r["lang"], np.array(r["grams"], np.int32)) for r in _grams_of(few.where(F.col("k") <= landmarks_per_label).select("lang", "text")).collect()]
    found = sorted(found, key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    vocabulary = np.unique(np.concatenate([g for _, g in found]))
    lookup = np.full(SPACE, -1, np.int32)
    lookup[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary), len(found)), np.float32)
    for j, (_, g) in enumerate(found):
        marks[lookup[g], j] = 1 / np.sqrt(len(g))
    kernel = (marks.T @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    model = Model(sorted(counts), lookup, marks, (vector[:, good] / np.sqrt(value[good])).astype(np.float32), None)
    shared = spark.sparkContext.broadcast(model)  # bounded by landmarks and gram codes

    def run(batches):
        for b in slices(batches, 1):
            langs = b.column(0).to_pylist()
            for at, x in shared.value.features(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at]), list_column(x.ravel(), np.full(len(at), x.shape[1]))], names=["lang", "x"])

    got = sorted(((r["lang"], r["x"]) for r in few.select("lang", "text").mapInArrow(run, "lang string, x array<float>").collect()), key=lambda r: (r[0], r[1]))
    x = np.array([r[1] for r in got], np.float64)
    y = np.array([[1.0 if r[0] == k else 0.0 for k in model.labels] for r in got])
    model.weights = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ y).astype(np.float32)
    shared.unpersist()
    return model


def classify(m: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if m:
        for at, x in m.features([t or "" for t in texts]):
            value = x @ m.weights
            for i, k, v in zip(at, value.argmax(1).tolist(), value.max(1).tolist()):
                label[i], score[i] = m.labels[k], min(1.0, max(0.0, v))
    return label, score


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the winning regression value cut to 0..1.

    Null texts, texts without a letter, and every text if no model could be
    fitted are ``und`` with score 0.  Ties go to the first label.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches, 1):
            label, score = classify(m, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; texts pass through the workers once, nothing is joined.

    Null texts, texts without a letter, and every text without a model are ``und``
    with score 0; ties go to the first label; repeated rows repeat.  Columns
    of the same names are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in slices(batches, at):
            label, score = classify(m, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One document in five by the checksum of its id; ids that are null are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
