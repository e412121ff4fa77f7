"""Command line: init, create-table, append, sync, seal, maintain, compact, retain, scan, value-at, latest, aggregate, sample."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import Db
from .errors import InvalidArgument, TidemarkError
from .functions.values import cell_text
from .model import Observation, Value

#: Names of the value types.
TYPES = {"uint": 1, "sq1": 2, "f32": 3}


def parse_value(text: str) -> Value:
    """u:N, q:CODE, f:HEX or null."""
    kind, _, raw = text.partition(":")
    try:
        if text == "null":
            return Value.null()
        if kind == "u":
            return Value.uint(int(raw))
        if kind == "q":
            return Value.sq1(int(raw))
        if kind == "f":
            return Value.f32_bits(int(raw, 16))
    except ValueError:
        pass
    raise InvalidArgument("value", text)


def parse_entry(text: str) -> tuple[int, int, Value]:
    """S:F:VALUE."""
    parts = text.split(":", 2)
    if len(parts) < 3:
        raise InvalidArgument("entry", text)
    return int(parts[0]), int(parts[1]), parse_value(parts[2])


def parse_key(text: str) -> tuple[int, int, int]:
    """T:S:F."""
    parts = text.split(":")
    if len(parts) != 3:
        raise InvalidArgument("key", text)
    return int(parts[0]), int(parts[1]), int(parts[2])


def parse_field(text: str) -> tuple[int, int]:
    """F:TYPE."""
    number, _, kind = text.partition(":")
    if kind not in TYPES:
        raise InvalidArgument("field", text)
    return int(number), TYPES[kind]


def lines(df: DataFrame, *columns) -> list[str]:
    return [r[0] for r in df.select(F.concat_ws("\t", *columns)).collect()]


def _cell():
    return cell_text(F.col("kind"), F.col("u"), F.col("q"), F.col("f"))


def show_lookup(df: DataFrame) -> list[str]:
    row = F.when(F.col("state") == "missing", "missing").when(F.col("state") == "null", F.concat_ws("\t", F.lit("null"), "at_ts")).otherwise(F.concat_ws("\t", F.lit("value"), "at_ts", _cell()))
    return lines(df, row)


def show_slots(df: DataFrame) -> list[str]:
    carried = F.when(F.col("carried"), "carried").otherwise("exact")
    rest = F.when(F.col("state") == "gap", "gap").when(F.col("state") == "null", F.concat_ws("\t", F.lit("null"), "source_ts", carried)).otherwise(F.concat_ws("\t", F.lit("value"), "source_ts", _cell(), carried))
    return lines(df, F.col("slot_ts").cast("string"), rest)


def show_buckets(df: DataFrame) -> list[str]:
    end = lambda m: F.when(F.coalesce(f"{m}_u", f"{m}_q", f"{m}_f").isNull(), "none").otherwise(cell_text(F.col("kind"), F.col(f"{m}_u"), F.col(f"{m}_q"), F.col(f"{m}_f")))
    total = F.when(F.col("sum").isNull(), "na").otherwise(F.concat(F.when(F.col("kind") == 2, "qfp4:").otherwise("u:"), F.col("sum").cast("string")))
    part = F.when(F.col("is_partial"), "partial").otherwise("complete")
    return lines(df, "start_ts", "end_ts", "sample_count", "null_count", end("min"), end("max"), total, part)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, *args):
        s = sub.add_parser(name)
        s.add_argument("root")
        for a, kind, n in args:
            s.add_argument(a, type=kind, nargs=n) if n else s.add_argument(a, type=kind)
        return s

    for name in ("init", "sync", "seal", "maintain"):
        verb(name)
    verb("create-table", ("fields", parse_field, "+")).add_argument("--validity", type=int)
    verb("append", ("table", int, None), ("ts", int, None), ("entries", parse_entry, "+"))
    verb("compact", ("level", str, None))
    verb("retain", ("cutoff", int, None))
    verb("scan", ("key", parse_key, None), ("start", int, None), ("end", int, None))
    verb("value-at", ("ts", int, None), ("keys", parse_key, "+"))
    verb("latest", ("keys", parse_key, "+"))
    verb("aggregate", ("start", int, None), ("end", int, None), ("width", int, None), ("keys", parse_key, "+"))
    verb("sample", ("start", int, None), ("end", int, None), ("step", int, None), ("keys", parse_key, "+"))
    return p


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """One command; returns its output lines."""
    a = parser().parse_args(argv)
    with Db(spark, a.root) as db:
        view = db.snapshot()
        match a.verb:
            case "init":
                return ["ok"]
            case "create-table":
                return [str(db.create_table(a.fields, a.validity))]
            case "append":
                return [str(db.append(a.table, Observation(a.ts, tuple(a.entries))))]
            case "sync":
                return [str(db.sync().seq)]
            case "seal":
                r = db.seal()
                return [f"{r.unit_id if r.unit_id is not None else '-'}\t{r.checkpointed_records}"]
            case "maintain":
                r = db.maintain()
                return [f"{r.synced}\t{r.sealed is not None}\t{r.compacted_l1 is not None}\t{r.compacted_l2 is not None}\t{r.more_due}".lower()]
            case "compact":
                if a.level not in ("l0", "l1"):
                    raise InvalidArgument("level", a.level)
                r = db.compact(int(a.level[1]))
                return [f"{r.input_units}\t{r.output_unit if r.output_unit is not None else '-'}"]
            case "retain":
                r = db.retain(a.cutoff)
                return [f"{r.removed_units}\t{r.floor if r.floor is not None else '-'}"]
            case "scan":
                return lines(view.scan(a.key, a.start, a.end), F.col("ts").cast("string"), _cell())
            case "value-at":
                return show_lookup(view.value_at(a.keys, a.ts))
            case "latest":
                return show_lookup(view.latest(a.keys))
            case "aggregate":
                return show_buckets(view.aggregate(a.keys, a.start, a.end, a.width))
            case "sample":
                return show_slots(view.sample(a.keys, a.start, a.end, a.step))
    return []


def main() -> int:
    spark = SparkSession.builder.appName("tidemark").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print("\n".join(run(spark, sys.argv[1:])))
    except TidemarkError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
