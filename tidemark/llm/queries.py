"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_langid, op2_kdtree, op3_chain, op4_cube, op5_rabitq, op6_packing, op7_suffix, op8_chosen_path, op9_debruijn, op10_digest
from .common import Work, documents, semi_reduce


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    work = Work(spark, "op1")
    model = op1_langid.train(docs.where(~op1_langid.held_out(F.col("doc_id"))).select("lang", "text"), work)
    return op1_langid.predict(docs, model).select("doc_id", op1_langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op2")
    assigned = op2_kdtree.shards(documents(spark, sf_dir), n_shards=8, work=work)
    return op2_kdtree.slots(assigned, work).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table has two categories, quality and toxicity; the chain predicts low quality first."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = op3_chain.train(docs, labels, ["low_quality", "toxic"], "toxic")
    return op3_chain.score(docs, chain, "toxic")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op4_cube.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2, work=Work(spark, "op4"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return op5_rabitq.near_links(vectors, "vec_id", "embedding", threshold=0.95, recall=0.999, work=Work(spark, "op5"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_suffix.repeats(documents(spark, sf_dir), span=50, work=Work(spark, "op7"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_chosen_path.similar(documents(spark, sf_dir), width=5, threshold=0.8, recall=0.999, work=Work(spark, "op8"))
    return found.select("doc_id", "class_id", "n_links", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_debruijn.repeats(documents(spark, sf_dir), span=50, work=Work(spark, "op9"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op6_packing.pack(documents(spark, sf_dir), tokenizer_path(), 2048, 1, Work(spark, "op6"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows repeat; a null id has no next document, so what depends on one is null."""
    return _op10(documents(spark, sf_dir), Work(spark, "op10"))


def _op10(docs: DataFrame, work: Work) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = lambda df: df.withColumn("row_key", op10_digest.row_key()).withColumn("place", op10_digest.place())
    links = op10_digest.next_ids(docs, work)
    both = op10_digest.edited(docs, links).unionByName(docs.where("doc_id is null").withColumn("edited", F.lit(None).cast("string")))
    canon = keyed(both).select(
        "doc_id",
        "place",
        "row_key",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        op10_digest.canonical(F.col("text")).alias("c"),
        op10_digest.canonical(F.col("edited")).alias("e"),
    )
    h1, h2 = op10_digest.hashes(F.col("c"))
    e1, e2 = op10_digest.hashes(F.col("e"))
    rows = work.save(canon.select("doc_id", "place", "row_key", "n_chars", "edited_sha256", h1, h2, e1.alias("e1"), e2.alias("e2")), "rows")
    digests = rows.select("place", "row_key", F.lit(0).alias("kind"), "h1", "h2").unionByName(
        rows.where("doc_id is not null").select("place", "row_key", F.lit(1).alias("kind"), F.col("e1").alias("h1"), F.col("e2").alias("h2"))
    )

    def reread(keep: DataFrame) -> DataFrame:
        changed = links.join(keep.where("kind = 1").select(F.col("place").alias("doc_id")), "doc_id", "left_semi")
        need = keep.select("place").union(changed.select("next_id"))
        some = semi_reduce(keyed(docs), "place", need)
        again = keyed(op10_digest.edited(some, changed)).select("place", "row_key", F.lit(1).alias("kind"), op10_digest.canonical(F.col("edited")).alias("canon"))
        return again.unionByName(some.select("place", "row_key", F.lit(0).alias("kind"), op10_digest.canonical(F.col("text")).alias("canon")))

    found = work.save(op10_digest.resolve(digests, ["place", "row_key", "kind"], reread, work).groupBy("place", "row_key").agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    ), "found")
    first = found.where("edited_fingerprint is not null").groupBy(F.col("place").alias("next_id")).agg(F.min_by("fingerprint", "row_key").alias("next_fingerprint"))
    after = links.join(first, "next_id").select(F.col("doc_id").alias("place"), "next_fingerprint")
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")  # noqa: E731  an exact digest is alike or not
    return rows.select("doc_id", "place", "row_key", "n_chars", "edited_sha256").join(found, ["place", "row_key"]).join(after, "place", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        alike("fingerprint", "edited_fingerprint").alias("near_edited"), F.when(F.col("doc_id").isNotNull(), alike("fingerprint", "next_fingerprint")).alias("near_next"),
    )


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: sizes and targets, to a thousandth."""
    mixed = op4_cube.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2, work=Work(spark, "op4"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fingerprints: the edited texts, without normal forms."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = op10_digest.edited(docs, op10_digest.next_ids(docs, Work(spark, "op10")))
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_language_id": op1_language_id,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_substring_dedup": op9_substring_dedup,
        "op6_packing": op6_packing_query,
        "op10_fingerprints": op10_fingerprints,
        "mixing_targets": mixing_targets,
        "fingerprint_edits": fingerprint_edits,
    }


_LABELS = """label AS (SELECT a AS id, least(a, min(b)) AS low FROM reach GROUP BY a)"""

#: All pairs, in double precision.
OP5_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  link AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
  reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), {_LABELS},
  n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
  FROM embeddings LEFT JOIN label ON label.id = vec_id LEFT JOIN n ON n.id = vec_id"""

OP7_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  b AS (SELECT doc_id, n, unnest(range(n)) AS p, x FROM d),
  s AS (SELECT doc_id, p, CASE WHEN p + 50 <= n THEN min(doc_id) OVER (PARTITION BY substr(x, 2 * p + 1, 100)) < doc_id ELSE false END AS later, substr(x, 2 * p + 1, 2) AS c FROM b),
  r AS (SELECT doc_id, p, c, max(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
  t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM r),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(c, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM t GROUP BY doc_id)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
  link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
  reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), {_LABELS},
  m AS (SELECT a AS id, count(*) AS m FROM link GROUP BY a)
  SELECT doc_id, coalesce(low, doc_id) AS class_id, coalesce(m, 0)::BIGINT AS n_links, doc_id = coalesce(low, doc_id) AS kept FROM documents LEFT JOIN label ON label.id = doc_id LEFT JOIN m ON m.id = doc_id"""

OP9_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
  s AS (SELECT doc_id, p, CASE WHEN p + 50 <= len(w) THEN min(doc_id) OVER (PARTITION BY w[p + 1:p + 50]) < doc_id ELSE false END AS later, w[p + 1] AS c FROM b),
  r AS (SELECT doc_id, p, c, max(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(c, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


#: Targets fill up at one rate a weight, but for sources that are full at twice their size: a prefix by size over weight.
MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
  w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY size / w, source NULLS LAST) AS k, (SELECT 1.5::DOUBLE * sum(size) FROM s) AS t FROM w),
  r AS (SELECT *, (t - coalesce(sum(2 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
  f AS (SELECT coalesce((SELECT arg_min(rate, k) FROM r WHERE rate * w <= 2 * size), 1e300) AS rate)
  SELECT doc_id, d.size AS size, r.size AS source_size, round(least(f.rate * w, 2.0 * r.size), 3)::DOUBLE AS target FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, f"""

EDITS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM d)
  SELECT doc_id, n AS n_chars, sha256(concat(substr(text, 1, n - n // 4), substr(after, 1, n // 4))) AS edited_sha256 FROM n"""


def oracle_sql() -> dict[str, str]:
    """Language ID, sharding, toxicity, sampling, packing and normal forms have no SQL; tests hold them against brute force."""
    return {"mixing_targets": MIXING_SQL, "fingerprint_edits": EDITS_SQL} | {"op5_embedding_near_dedup": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op9_substring_dedup": OP9_SQL}
