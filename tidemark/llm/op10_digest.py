"""Document fingerprints: canonical exact digests.

Text is put into Unicode compatibility form (NFKC), case and white space are
folded, and rows are grouped by a 128-bit xxhash of the result.  Inside each
bucket with more than one row the canonical bytes themselves are compared, so
two different texts never share a fingerprint, even if their hashes collide.
Everything runs as JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work, parts, semi_reduce, small

SPACE = r"[\s\p{Z}\x{0085}]+"


def canonical(text: Column) -> Column:
    """NFKC, lower case, NFKC again (case folding can leave composable pairs), runs of white space to one space, trimmed; null is empty."""
    form = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    wide = F.lower(F.upper(form(text)))
    plain = F.octet_length(text) == F.length(text)  # ASCII alone
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(form(wide)), SPACE, " "))


def hashes(text: Column) -> list[Column]:
    """Two 64-bit halves of the wide hash of an already canonical text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(0x9E3779B9), text, F.length(text)).alias("h2")]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows of one id apart; equal rows agree."""
    return F.xxhash64(F.col(id_col), F.lit(10), F.col(text_col))


def place(id_col: str = "doc_id", key: str = "row_key") -> Column:
    """The id, or the row's key where it is null: with the key it names a row, can be joined and puts null ids in no one task."""
    return F.coalesce(F.col(id_col), F.col(key))


def resolve(digests: DataFrame, keys: list[str], reread: Callable[[DataFrame], DataFrame], work: Work) -> DataFrame:
    """``digests`` (keys, h1, h2) with a column ``fingerprint``.

    The keys name a row (equal rows may share them) and are not null.
    ``reread(rows)`` returns (keys, canon) for the given key rows.  Rows that
    share a wide hash with another row have their canonical bytes grouped, after
    map-side aggregation, by (h1, h2, canon): a bucket with one text keeps the
    bare hash, a bucket with several texts numbers them in byte order.  A hot
    group of equal texts shrinks to a row for each task before the shuffle.
    """
    shared = digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = work.save(digests.join(shared, ["h1", "h2"]).select(*keys, "h1", "h2").distinct(), "members")
    own = reread(members.select(*keys)).select(*keys, "canon", *hashes(F.col("canon")))
    texts = own.join(members, [*keys, "h1", "h2"]).distinct()
    kinds = texts.groupBy("h1", "h2", "canon").agg(F.count("*").alias("n"))
    clash = kinds.groupBy("h1", "h2").agg(F.count("*").alias("kinds")).where("kinds > 1")
    clash = work.save(clash, "clash")
    name = F.concat(F.lower(F.lpad(F.hex("h1"), 16, "0")), F.lower(F.lpad(F.hex("h2"), 16, "0")))
    out = digests.withColumn("fingerprint", name)
    if clash.isEmpty():
        return out
    order = W.partitionBy("h1", "h2").orderBy("canon")
    ranked = kinds.join(clash, ["h1", "h2"]).withColumn("k", F.row_number().over(order))
    which = texts.join(ranked.select("h1", "h2", "canon", "k"), ["h1", "h2", "canon"]).select(*keys, "h1", "h2", "canon", "k")
    which = which.groupBy(*keys, "h1", "h2").agg(F.min("k").alias("k"))  # a row for each key
    return out.join(which, [*keys, "h1", "h2"], "left").withColumn(
        "fingerprint", F.when(F.col("k") > 1, F.concat("fingerprint", F.lit("-"), F.col("k").cast("string"))).otherwise(F.col("fingerprint"))
    ).drop("k")


def fingerprints(df: DataFrame, id_col: str, text_col: str, work: Work | None = None) -> DataFrame:
    """(id, fingerprint): equal canonical texts, and only those, share a fingerprint.

    Null and empty texts have the fingerprint of the empty text.  Repeated rows
    repeat; a null id keeps its row.  Other columns are ignored.
    """
    work = work or Work(df.sparkSession, "digest")
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("row_key", row_key("id")).withColumn("place", F.coalesce(F.col("id").cast("string"), F.col("row_key").cast("string")))
    rows = keyed.select("id", "place", "row_key", canonical(F.col("text")).alias("canon"))
    digests = work.save(rows.select("id", "place", "row_key", *hashes(F.col("canon"))), "digests")

    def reread(keep: DataFrame) -> DataFrame:
        return semi_reduce(rows.drop("id"), "place", keep.select("place")).join(keep.distinct(), ["place", "row_key"], "left_semi")

    return resolve(digests, ["place", "row_key"], reread, work).select(F.col("id").alias(id_col), "fingerprint")


def next_ids(ids: DataFrame, work: Work) -> DataFrame:
    """(doc_id, next_id): the following id in ascending order; after the last comes the first.

    Distinct ids are dealt to ranges of near equal numbers of ids, however far
    apart they lie, each range is ordered on its own, and a range's last id takes
    the first id of the next range (one row a range).  Null ids have no next.
    """
    ids = ids.select("doc_id").where("doc_id is not null").distinct()
    ids = work.save(ids.repartitionByRange(parts(work.spark), "doc_id").withColumn("cell", F.spark_partition_id()), "ranges")
    first = ids.groupBy("cell").agg(F.min("doc_id").alias("first_id"))
    low = F.lit(first.agg(F.min("first_id")).first()[0]).cast("long")
    over = first.select("cell", F.coalesce(F.lead("first_id").over(W.orderBy("cell")), low).alias("first_next"))
    own = F.lead("doc_id").over(W.partitionBy("cell").orderBy("doc_id"))
    return work.save(
        ids.withColumn("own", own).join(small(over, parts(work.spark)), "cell").select("doc_id", F.coalesce("own", "first_next").alias("next_id")), "next"
    )


def edited(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, text, edited) of the rows whose id has a link: the last quarter of the code points replaced by the first as many of the next document.

    ``docs`` must hold all rows of both ends of the ``links`` (doc_id, next_id).
    Of several rows of the next id, the one with the lowest ``row_key`` is the
    next document.  Only the quarter that is needed of its text travels, to the
    id, once, so rows of one id are never multiplied.
    """
    docs = docs.select("doc_id", "text")  # the same columns in both joins, so they share a shuffle
    ids = docs.groupBy("doc_id").agg(F.min(row_key()).alias("lowest"), F.max(F.floor(F.length("text") / 4)).cast("int").alias("k"))
    need = links.join(ids.select("doc_id", "k"), "doc_id").select(F.col("doc_id").alias("into"), F.col("next_id").alias("doc_id"), "k")
    need = need.join(ids.select("doc_id", "lowest"), "doc_id")
    tail = docs.join(need, "doc_id").where(row_key() <= F.col("lowest")).select(F.col("into").alias("doc_id"), F.expr("substring(text, 1, k)").alias("tail"))
    tail = tail.groupBy("doc_id").agg(F.max("tail").alias("tail"))  # equal rows
    cut = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))")
    end = F.expr("substring(tail, 1, cast(floor(length(text) / 4) as int))")
    return docs.join(tail, "doc_id").select("doc_id", "text", F.concat(cut, end).alias("edited"))
