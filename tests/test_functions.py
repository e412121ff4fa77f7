import struct

from pyspark.sql import functions as F

from tidemark.functions import codec, values


def test_sq1_and_quantise(spark):
    rows = spark.range(256).select("id", values.sq1_fp4(F.col("id")).alias("v")).collect()
    got = {r["id"]: r["v"] for r in rows}
    assert (got[0], got[50], got[78], got[254], got[255]) == (0, 50_000, 120_000, 1_000_000, None)
    back = spark.range(255).select("id", values.sq1_quantize(values.sq1_fp4(F.col("id")) / 100).alias("c"))
    assert all(r["id"] == r["c"] for r in back.collect())


def test_f32_total_order(spark):
    patterns = [0xFFC00001, 0xFF800000, 0xBF800000, 0x80000000, 0, 1, 0x3F800000, 0x7F800000, 0x7FC01234]
    df = spark.createDataFrame([(p,) for p in reversed(patterns)], "f long")
    assert [r["f"] for r in df.orderBy(values.f32_order(F.col("f"))).collect()] == patterns
    x = spark.createDataFrame([(1.5,), (-0.0,), (None,)], "v float")
    assert [r[0] for r in x.select(values.f32_bits(F.col("v"))).collect()] == [struct.unpack("<I", struct.pack("<f", 1.5))[0], 0x80000000, None]


def test_token_stream_vectors():
    h = lambda s: codec.nvr_bytes(s).hex()
    assert h([1, 0, 0, None, None, 64]) == "0182c24001" and h([63]) == "3f"
    assert h([0] * 31) == "9f" and h([0] * 32) == "a001" and h([None] * 15) == "cf" and h([None] * 16) == "d001"


def test_fixed_vector():
    assert codec.fixed_bytes([1, None, 0x0203]).hex() == "020201000302" and codec.fixed_bytes([7]).hex() == "0107"


def test_token_sizes_match_bytes(spark):
    import random

    r = random.Random(1)
    symbols = [r.choice([None, 0, 0, r.randrange(2 ** r.randrange(1, 40))]) for _ in range(500)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(symbols)], "k int, ts long, code long")
    assert codec.run_tokens(df, ["k"]).agg(F.sum("size")).first()[0] == len(codec.nvr_bytes(symbols))
    wide = df.withColumn("u", F.col("code").cast("decimal(20,0)"))
    back = codec.undelta2(codec.delta2(wide, ["k"]), ["k"]).orderBy("ts").collect()
    assert [None if x["decoded"] is None else int(x["decoded"]) for x in back] == symbols
    bits = df.withColumn("f", F.col("code") % 4294967296)
    back = codec.unxor(codec.xor_previous(bits, ["k"]), ["k"]).orderBy("ts").collect()
    assert [x["decoded"] for x in back] == [None if s is None else s % 2**32 for s in symbols]


def test_decoders_invert_encoders():
    import random

    r = random.Random(3)
    for n in range(200):
        values = [r.choice([None, 0, 7, r.randrange(2 ** r.randrange(1, 65))]) for _ in range(r.randrange(0, 90))]
        assert codec.nvr_symbols(codec.nvr_bytes(values)) == values
        assert codec.delta2_values(codec.delta2_symbols(values)) == values
        assert codec.fixed_values(codec.fixed_bytes(values), len(values), values.count(None)) == values
        present = [v is not None for v in values]
        assert codec.presence_rows(codec.presence_bytes(present), len(present)) == present
    assert codec.presence_bytes([True] * 9) == b"" and codec.presence_bytes([True] * 8 + [False]) == b"\xff\x00"


def test_sections_of_wide_values_and_times_survive(spark):
    rows = [(1, ts, u) for ts, u in ((-(2**62), 0), (-5, 2**64 - 1), (0, None), (2**62, 3))] + [(2, 9, None), (3, 10, 2**40), (3, 13, 2**40 + 1), (3, 16, 2**40 + 2), (4, 0, 2**63), (4, 1, 2**63)]
    df = spark.createDataFrame([(k, t, None if u is None else __import__("decimal").Decimal(u)) for k, t, u in rows], "k int, ts long, u decimal(20,0)")
    packed = codec.pack_sections(df, ["k"])
    assert {r["k"]: (r["rows"], r["nulls"], r["encoding"]) for r in packed.collect()} == {1: (4, 1, "fixed"), 2: (1, 1, "runs"), 3: (3, 0, "runs"), 4: (2, 0, "fixed")}
    got = codec.unpack_sections(packed, ["k"]).collect()
    assert sorted((r["k"], r["ts"], None if r["value"] is None else int(r["value"])) for r in got) == sorted(rows)


def test_splitmix_and_lerp(spark):
    from tidemark.sources.workload import lerp, splitmix

    def mixed(v):  # fixed values: the constants of the generator
        v = (v + 0x9E3779B97F4A7C15) % 2**64
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        v = (v ^ v >> 27) * 0x94D049BB133111EB % 2**64
        return v ^ v >> 31

    for r in spark.range(50).select("id", splitmix(F.col("id") * 7919).alias("m"), lerp(F.lit(-100), F.lit(57), F.col("id"), F.lit(49)).alias("l")).collect():
        assert int(r["m"]) == mixed(r["id"] * 7919) and r["l"] == -100 + int(157 * r["id"] / 49)
