"""Encoding transforms and size estimates over (stream, ts, value) rows.

Storage itself is Parquet; these queries tell what the run-length and fixed
encodings would take, give the reversible delta forms, and pack and unpack
sections.  A section of a stream is encoded by itself, so give keys with a section
(``sections``): then no task orders a whole stream.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import ship_package
from .values import WIDE, fixed_width, unzigzag, varint_extra, zigzag


def sections(df: DataFrame, start: int, width: int) -> DataFrame:
    """``section``: the number of the stretch of time of a row."""
    return df.withColumn("section", F.expr(f"(ts - {start}L) div {width}L"))


def _ordered(keys: list[str]):
    return W.partitionBy(*keys).orderBy("ts")


def delta2(df: DataFrame, keys: list[str], value: str = "u") -> DataFrame:
    """``code``: zigzag of the second difference; nulls stay null and do not advance the predictor."""
    w = _ordered(keys).rowsBetween(W.unboundedPreceding, -1)
    v = F.col(value).cast(WIDE)
    one = F.last(v, ignorenulls=True).over(w)
    step = v - F.coalesce(one, F.lit(0).cast(WIDE))
    df = df.withColumn("_step", step)
    before = F.last("_step", ignorenulls=True).over(w)
    return df.withColumn("code", F.when(v.isNotNull(), zigzag(F.col("_step") - F.coalesce(before, F.lit(0).cast(WIDE))))).drop("_step")


def undelta2(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Inverse of ``delta2``: two running sums."""
    w = _ordered(keys).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_step", F.sum(unzigzag(F.col(code))).over(w))
    df = df.withColumn("_step", F.when(F.col(code).isNotNull(), F.col("_step").cast(WIDE)))
    return df.withColumn("decoded", F.when(F.col(code).isNotNull(), F.sum("_step").over(w).cast(WIDE))).drop("_step")


def xor_previous(df: DataFrame, keys: list[str], bits: str = "f") -> DataFrame:
    """``code``: the pattern xor the last non-null one."""
    before = F.last(bits, ignorenulls=True).over(_ordered(keys).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("code", F.col(bits).bitwiseXOR(F.coalesce(before, F.lit(0).cast("long"))))


def unxor(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Inverse of ``xor_previous``: a running exclusive or, bit by bit as running parities."""
    w = _ordered(keys).rowsBetween(W.unboundedPreceding, 0)
    c = F.coalesce(F.col(code), F.lit(0).cast("long"))
    parts = [F.shiftleft(F.sum(F.shiftright(c, b).bitwiseAND(F.lit(1))).over(w) % 2, b) for b in range(32)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("decoded", F.when(F.col(code).isNotNull(), total))


def run_tokens(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """(keys, token, first_ts, length, size): literals one by one, runs of zeros and of nulls joined; ``size`` in bytes."""
    kind = F.when(F.col(code).isNull(), "null").when(F.col(code) == 0, "zero").otherwise("lit")
    w = _ordered(keys)
    df = df.withColumn("token", kind)
    new = (F.col("token") == "lit") | F.coalesce(F.lag("token").over(w) != F.col("token"), F.lit(True))
    df = df.withColumn("_run", F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_run", "token").agg(F.min("ts").alias("first_ts"), F.count("*").alias("length"), F.max(F.col(code).cast(WIDE)).alias("_code"))
    return runs.withColumn("size", token_size(F.col("token"), F.col("length"), F.col("_code"))).drop("_run", "_code")


def token_size(token: Column, length: Column, code: Column) -> Column:
    """A literal's first byte carries 6 bits, a zero run's 5 and a null run's 4."""
    return 1 + F.when(token == "lit", varint_extra(code, 6)).when(token == "zero", varint_extra(length, 5)).otherwise(varint_extra(length, 4))


def encoding_choice(df: DataFrame, keys: list[str], value: str = "u") -> DataFrame:
    """(keys, rows, fixed_bytes, run_bytes, encoding): the run encoding only where it is strictly smaller."""
    fixed = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), (1 + fixed_width(F.coalesce(F.max(value), F.lit(0))) * F.count(value) + F.when(F.count(value) < F.count("*"), F.ceil(F.count("*") / 8)).otherwise(0)).cast("long").alias("fixed_bytes")
    )
    run = run_tokens(delta2(df, keys, value), keys).groupBy(*keys).agg(F.sum("size").cast("long").alias("run_bytes"))
    return fixed.join(run, keys).withColumn("encoding", F.when(F.col("run_bytes") < F.col("fixed_bytes"), "runs").otherwise("fixed"))


def presence_size(df: DataFrame, keys: list[str], section: list[str]) -> DataFrame:
    """(keys, facts, rows, presence_bytes): a bit for each row (distinct ts) of the section unless the stream has a fact in all of them."""
    rows = df.groupBy(*section).agg(F.countDistinct("ts").alias("rows"))
    facts = df.groupBy(*section, *keys).agg(F.count("*").alias("facts"))
    size = F.when(F.col("facts") == F.col("rows"), 0).otherwise(F.ceil(F.col("rows") / 8)).cast("long")
    return facts.join(rows, section).select(*section, *keys, "facts", "rows", size.alias("presence_bytes"))


def fixed_bytes(values: list[int | None]) -> bytes:
    """Unsigned integers at one width: the width, a bit for each null if there are any, then the values, little-endian."""
    top = max((v for v in values if v is not None), default=0)
    width = 1 if top < 256 else 2 if top < 65536 else 4 if top < 2**32 else 8
    nulls = sum(1 << i for i, v in enumerate(values) if v is None)
    bitmap = nulls.to_bytes(-(-len(values) // 8), "little") if nulls else b""
    return bytes([width]) + bitmap + b"".join(v.to_bytes(width, "little") for v in values if v is not None)


def presence_bytes(present: list[bool]) -> bytes:
    """Which rows of a section a stream has: nothing if all, else a bit a row."""
    return b"" if all(present) else sum(1 << i for i, p in enumerate(present) if p).to_bytes(-(-len(present) // 8), "little")


def presence_rows(data: bytes, n: int) -> list[bool]:
    """The inverse of ``presence_bytes`` for n rows."""
    bits = int.from_bytes(data, "little")
    return [not data or bool(bits >> i & 1) for i in range(n)]


def nvr_bytes(symbols: list[int | None]) -> bytes:
    """The byte stream of one column, for golden vectors and small exports."""
    out = bytearray()

    def put(tag: int, bits: int, n: int) -> None:
        mask = (1 << bits) - 1
        more = n >> bits
        out.append(tag | n & mask | (0x40 if tag == 0 and more else 0x20 if tag == 0x80 and more else 0x10 if tag == 0xC0 and more else 0))
        while more:
            out.append(more & 0x7F | (0x80 if more >> 7 else 0))
            more >>= 7

    i = 0
    while i < len(symbols):
        s, j = symbols[i], i
        if s is not None and s != 0:
            put(0, 6, s)
            i += 1
            continue
        while j < len(symbols) and symbols[j] == s and (s is None) == (symbols[j] is None):
            j += 1
        put(0xC0 if s is None else 0x80, 4 if s is None else 5, j - i)
        i = j
    return bytes(out)


def nvr_symbols(data: bytes) -> list[int | None]:
    """The inverse of ``nvr_bytes``."""
    out, i = [], 0
    while i < len(data):
        first, i = data[i], i + 1
        bits, flag = (6, 0x40) if first < 0x80 else (5, 0x20) if first < 0xC0 else (4, 0x10)
        n, shift, more = first & (1 << bits) - 1, bits, bool(first & flag)
        while more:
            n, shift, more, i = n | (data[i] & 0x7F) << shift, shift + 7, data[i] >= 0x80, i + 1
        out += [n] if first < 0x80 else [0] * n if first < 0xC0 else [None] * n
    return out


def fixed_values(data: bytes, n: int, nulls: int) -> list[int | None]:
    """The inverse of ``fixed_bytes`` for n values, so many of them null."""
    width, size = data[0], -(-n // 8) if nulls else 0
    bitmap = int.from_bytes(data[1 : 1 + size], "little")
    out, at = [], 1 + size
    for i in range(n):
        if bitmap >> i & 1:
            out.append(None)
        else:
            out.append(int.from_bytes(data[at : at + width], "little"))
            at += width
    return out


def delta2_symbols(values: list[int | None]) -> list[int | None]:
    """Zigzag second differences of a list; nulls stay and do not advance the predictor."""
    last = step = 0
    out = []
    for v in values:
        if v is None:
            out.append(None)
            continue
        d = v - last - step
        out.append(2 * d if d >= 0 else -2 * d - 1)
        last, step = v, v - last
    return out


def delta2_values(symbols: list[int | None]) -> list[int | None]:
    last = step = 0
    out = []
    for s in symbols:
        if s is not None:
            step += s // 2 if s % 2 == 0 else -(s + 1) // 2
            last += step
        out.append(None if s is None else last)
    return out


def encode(values: list[int | None], fixed: bytes) -> tuple[str, bytes]:
    """Runs of second differences where they are strictly smaller and fit 64 bits, else the fixed form."""
    symbols = delta2_symbols(values)
    runs = nvr_bytes(symbols) if all(s is None or s < 2**64 for s in symbols) else None
    return ("runs", runs) if runs is not None and len(runs) < len(fixed) else ("fixed", fixed)


def pack_sections(df: DataFrame, keys: list[str], value: str = "u") -> DataFrame:
    """(keys, rows, nulls, time_encoding, times, encoding, data): one row a section, unsigned integers or nulls.

    Times are 8 bytes each in the fixed form.  A section's rows are held at once.
    """
    ship_package(df.sparkSession)
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", F.col(value).cast(WIDE).alias("v")))).alias("rows"))
    kinds = [rows.schema[k] for k in keys]

    def run(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for section in b.column(len(keys)).to_pylist():
                times, values = [r["ts"] for r in section], [None if r["v"] is None else int(r["v"]) for r in section]
                out[0].append(len(section))
                out[1].append(values.count(None))
                for k, (encoding, data) in ((2, encode(times, b"".join(t.to_bytes(8, "little", signed=True) for t in times))), (4, encode(values, fixed_bytes(values)))):
                    out[k].append(encoding)
                    out[k + 1].append(data)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array(x, t) for x, t in zip(out, types))], names=[*keys, "rows", "nulls", "time_encoding", "times", "encoding", "data"])

    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds) + ", rows long, nulls long, time_encoding string, times binary, encoding string, data binary"
    return rows.mapInArrow(run, schema)


def unpack_sections(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, value): the inverse of ``pack_sections``."""
    ship_package(packed.sparkSession)
    columns = [*keys, "rows", "nulls", "time_encoding", "times", "encoding", "data"]
    kinds = [packed.schema[k] for k in keys]

    def run(batches):
        from decimal import Decimal

        for b in batches:
            for i in range(b.num_rows):
                n, nulls, time_encoding, times, encoding, data = (b.column(len(keys) + k)[i].as_py() for k in range(6))
                ts = delta2_values(nvr_symbols(times)) if time_encoding == "runs" else [int.from_bytes(times[8 * k : 8 * k + 8], "little", signed=True) for k in range(n)]
                values = delta2_values(nvr_symbols(data)) if encoding == "runs" else fixed_values(data, n, nulls)
                own = [b.column(k).take(pa.array([i] * n)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ts, pa.int64()), pa.array([None if v is None else Decimal(v) for v in values], pa.decimal128(20, 0))], names=[*keys, "ts", "value"])

    return packed.select(*columns).mapInArrow(run, ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds) + ", ts long, value decimal(20,0)")
