"""An immutable view of a database: catalogue, unit files and tail as of one moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Corruption, InvalidArgument
from .model import FACTS, KEY, KEYS, VALUE, VERSIONS, Field, TableVersion
from .operators import aggregate, lookup, sample, scan
from .plans.guards import check_floor, check_range, check_step, prune, slots
from .sources import units as unit_files

Key = tuple[int, int, int]
#: A request: a list of streams, or a frame (ord, table_id, series_id, field_id) of any number of them.
Keys = list[Key] | DataFrame


def signed(n: int) -> int:
    """An unsigned 64-bit id as the long that carries its bits."""
    return n - 2**64 if n >= 2**63 else n


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, state: dict, tail: list[tuple], ticks: int):
        self.spark, self.root, self.state, self.tail, self.ticks = spark, root, state, list(tail), ticks
        self.unit_paths = {u["path"] for u in state["units"]} | ({state["heads"]} if state["heads"] else set())
        self._check_order()

    def _check_order(self) -> None:
        """Units and tail of a table follow each other in time; one row a unit and table."""
        spans = [(table, low, high, u["path"]) for u in self.state["units"] for table, (low, high) in u["tables"].items()]
        first: dict[str, int] = {}
        for row in self.tail:
            first[str(row[0])] = min(row[3], first.get(str(row[0]), row[3]))
        spans += [(table, low, low, "the tail") for table, low in first.items()]
        spans.sort(key=lambda x: (x[0], x[1]))
        for a, b in zip(spans, spans[1:]):
            if a[0] == b[0] and b[1] <= a[2]:
                raise Corruption(b[3], f"table {a[0]} has facts there and in {a[3]} at {b[1]}")

    # --- frames ---

    def facts(self, low: int | None = None, high: int | None = None, tables: set[int] | None = None) -> DataFrame:
        """Sealed and pending facts of live tables; units outside [low, high), or without one of ``tables``, are not opened."""
        return self._union(prune(self.state["units"], low, high, tables), [])

    def facts_upto(self, t: int | None, high: int | None = None, tables: set[int] | None = None) -> DataFrame:
        """What lookups at t or later need: of units that end at t or before only each stream's last fact, the rest up to ``high`` whole."""
        some = prune(self.state["units"], None, high if high is not None else (None if t is None else t + 1), tables)
        ends = lambda u: t is None or u["max_ts"] <= t
        return self._union([u for u in some if not ends(u)], [u for u in some if ends(u)])

    def _union(self, whole: list[dict], ended: list[dict]) -> DataFrame:
        live = [int(t) for t in self.state["tables"]]
        paths = [f"{self.root}/{u['path']}/facts" for u in whole] + [f"{self.root}/{u['path']}/last" for u in ended]
        rows = unit_files.read(self.spark, paths)
        if self.tail:
            pending = self.spark.createDataFrame(self.tail, FACTS)
            rows = rows.unionByName(pending) if paths else pending
        return rows.where(F.col("table_id").isin(live))

    def heads(self) -> DataFrame | None:
        if not self.state["heads"]:
            return None
        return unit_files.read(self.spark, [f"{self.root}/{self.state['heads']}/facts"]).where(F.col("table_id").isin([int(t) for t in self.state["tables"]]))

    def versions_frame(self) -> DataFrame:
        rows = []
        for t, x in self.state["tables"].items():
            active = [v for v in x["versions"] if v["effective_from"] is not None]
            for v, after in zip(active, [*active[1:], None]):
                rows.append((int(t), v["no"], v["effective_from"], after and after["effective_from"], v["validity_s"]))
        return self.spark.createDataFrame(rows, VERSIONS)

    def tables_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(int(t), x["last_ts"]) for t, x in self.state["tables"].items()], "table_id long, last_ts long")

    def fields_frame(self) -> DataFrame:
        rows = [(int(t), f, k) for t, x in self.state["tables"].items() for f, k in x["versions"][-1]["fields"]]
        return self.spark.createDataFrame(rows, "table_id long, field_id int, value_type int")

    def _retired(self) -> tuple[DataFrame | None, DataFrame | None]:
        series = [(int(t), signed(int(s)), c) for t, x in self.state["tables"].items() for s, c in x["retired_series"].items()]
        fields = [(int(t), int(f), c) for t, x in self.state["tables"].items() for f, c in x["retired_fields"].items()]
        return (
            self.spark.createDataFrame(series, "table_id long, series_id long, cutoff long") if series else None,
            self.spark.createDataFrame(fields, "table_id long, field_id int, cutoff long") if fields else None,
        )

    def streams(self, table: int) -> DataFrame:
        """(table_id, series_id, field_id) of every stream of a table that has a sealed or pending fact."""
        self._table(table)
        return self.facts_upto(None, None, {table}).where(F.col("table_id") == table).select(*KEY).distinct()

    def _request(self, keys: Keys) -> tuple[DataFrame, set[int], int]:
        """The request as a frame, its tables, and the number of keys that share the slot limit.

        A list is held by the driver, so its keys share the limit; the keys of a
        frame stay on executors, and each may have as many slots as the limit says.
        """
        if isinstance(keys, DataFrame):
            kinds = keys.select("table_id", "field_id").distinct().collect()  # one row a field of the catalogue
            self._check_fields((r["table_id"], r["field_id"]) for r in kinds)
            return keys.select("ord", *KEY), {r["table_id"] for r in kinds}, 1
        return self._keys(keys), {k[0] for k in keys}, len(keys)

    def _keys(self, keys: list[Key]) -> DataFrame:
        self._check_fields((t, f) for t, _, f in keys)
        return self.spark.createDataFrame([(i, t, signed(s), f) for i, (t, s, f) in enumerate(keys)], KEYS)

    def _check_fields(self, fields) -> None:
        for t, f in fields:
            table = self._table(t)
            if f not in {x for x, _ in table["versions"][-1]["fields"]}:
                raise InvalidArgument("key", f"table {t} has no field {f}")

    def _table(self, table: int) -> dict:
        if str(table) not in self.state["tables"]:
            raise InvalidArgument("table", f"{table} does not exist")
        return self.state["tables"][str(table)]

    # --- queries ---

    def scan(self, key: Key, start: int, end: int) -> DataFrame:
        self._keys([key])
        check_range(start, end, self.state["floor"])
        return scan.scan(self.facts(start, end, {key[0]}), key[0], signed(key[1]), key[2], start, end).select("ts", *VALUE)

    def value_at(self, keys: list[Key], t: int) -> DataFrame:
        check_floor(t, self.state["floor"])
        series, fields = self._retired()
        return lookup.value_at(self.facts_upto(t, None, {k[0] for k in keys}), self._keys(keys), t, self.versions_frame(), series, fields, self.heads(), self.ticks).orderBy("ord")

    def latest(self, keys: list[Key]) -> DataFrame:
        series, fields = self._retired()
        return lookup.latest(self.facts_upto(None, None, {k[0] for k in keys}), self._keys(keys), self.tables_frame(), self.versions_frame(), series, fields, self.heads(), self.ticks).orderBy("ord")

    def aggregate(self, keys: Keys, start: int, end: int, width: int) -> DataFrame:
        check_range(start, end, self.state["floor"])
        check_step(width, "width")
        asked, tables, sharing = self._request(keys)
        slots(start, end, width, sharing)
        out = aggregate.aggregate(self.facts(start, end, tables), asked, self.tables_frame(), start, end, width, fields=self.fields_frame())
        return out.orderBy("ord", "start_ts")

    def sample(self, keys: Keys, start: int, end: int, step: int) -> DataFrame:
        check_range(start, end, self.state["floor"])
        check_step(step, "step")
        asked, tables, sharing = self._request(keys)
        slots(start, end, step, sharing)
        series, fields = self._retired()
        out = sample.sample(self.facts_upto(start, end, tables), asked, start, end, step, sharing, self.versions_frame(), series, fields, self.heads(), self.ticks)
        return out.orderBy("ord", "slot_ts")

    def table_last_timestamp(self, table: int) -> int | None:
        return self._table(table)["last_ts"]

    def table_versions(self, table: int) -> list[TableVersion]:
        return [TableVersion(v["no"], v["validity_s"], tuple(Field(f, k) for f, k in v["fields"]), v["effective_from"]) for v in self._table(table)["versions"]]

    def retention_floor(self) -> int | None:
        return self.state["floor"]


__all__ = ["KEY", "Snapshot", "signed"]
