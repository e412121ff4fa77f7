"""Schemas of the tables that operators work on, and result types."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import InvalidArgument, ResourceExhausted

FACTS = "table_id long, series_id long, field_id int, ts long, kind tinyint, u decimal(20,0), q smallint, f long"
#: Facts as units store them: one number a fact, and integers from 2^63 on apart.
STORED = "table_id long, series_id long, field_id int, ts long, kind tinyint, val long, big decimal(20,0)"
KEYS = "ord int, table_id long, series_id long, field_id int"
VERSIONS = "table_id long, version_no int, effective_from long, effective_to long, validity_s long"
KEY = ["table_id", "series_id", "field_id"]
VALUE = ["kind", "u", "q", "f"]

#: Limits on one request and on catalogue objects.
MAX_SLOTS = 1_048_576
SECTION_ROWS = 65_536
TAIL_LIMIT = 64 << 20
MAX_SEAL_MEMORY, MAX_DIRECTORY_CACHE = 256 << 20, 16 << 20


@dataclass(frozen=True)
class Value:
    """A typed value; ``kind`` 0 is an explicit null."""

    kind: int
    raw: int | None = None

    @staticmethod
    def uint(n: int) -> Value:
        return Value(1, n)

    @staticmethod
    def sq1(code: int) -> Value:
        return Value(0) if code == 255 else Value(2, code)

    @staticmethod
    def f32_bits(bits: int) -> Value:
        return Value(3, bits)

    @staticmethod
    def null() -> Value:
        return Value(0)


@dataclass(frozen=True)
class Observation:
    ts: int
    entries: tuple[tuple[int, int, Value], ...]  # (series, field, value), strictly increasing by (series, field)


@dataclass(frozen=True)
class Field:
    field_id: int
    value_type: int


@dataclass(frozen=True)
class TableVersion:
    version_no: int
    validity_s: int | None
    fields: tuple[Field, ...]
    effective_from: int | None


@dataclass
class SealReport:
    unit_id: int | None
    checkpointed_records: int


@dataclass
class CompactReport:
    input_units: int
    output_unit: int | None


@dataclass
class RetentionReport:
    removed_units: int
    floor: int | None


@dataclass
class MaintenanceReport:
    synced: bool = False
    sealed: SealReport | None = None
    compacted_l1: CompactReport | None = None
    compacted_l2: CompactReport | None = None
    more_due: bool = False


@dataclass
class OpenReport:
    """Log files are published whole, so there are never torn tails to repair, and opening seals nothing."""

    elapsed: float
    replayed_records: int
    removed_orphans: int
    wal_bytes: int = 0
    wal_storage_bytes: int = 0
    tail_repairs: int = 0
    repaired_bytes: int = 0
    recovery_checkpointed_records: int = 0
    recovery_unit_id: int | None = None


@dataclass
class MaintenanceStatus:
    sync_due: bool
    seal_due: bool
    sync_due_in: float | None
    seal_due_in: float | None
    unsynced_records: int
    unsynced_bytes: int
    pending_records: int
    tail_bytes: int
    wal_bytes: int
    wal_storage_bytes: int
    directory_cache_bytes: int
    visible_seq: int
    durable_seq: int
    level_units: list[int] = field(default_factory=lambda: [0, 0, 0])
    retention_floor: int | None = None


@dataclass(frozen=True)
class DurablePosition:
    seq: int
    generation: int


@dataclass(frozen=True)
class SharedStatus:
    """Of a namespace's log: bytes kept and buffered, numbers of the last durable and visible record, writes and syncs done."""

    storage_bytes: int
    buffered_bytes: int
    durable_lsn: int
    visible_lsn: int
    write_calls: int
    sync_calls: int
    members: int


@dataclass
class SyncPolicy:
    """``manual``: only explicit syncs."""

    every_s: float = 1.0
    bytes: int = 262_144
    manual: bool = False


@dataclass
class SealPolicy:
    tail_bytes: int = 2_621_440
    every_s: float = 300.0
    memory_bytes: int = 32 << 20


@dataclass
class CompactionPolicy:
    l1_window: int = 2 * 3600
    l2_window: int = 24 * 3600


@dataclass
class OpenOptions:
    sync: SyncPolicy = field(default_factory=SyncPolicy)
    seal: SealPolicy = field(default_factory=SealPolicy)
    compaction: CompactionPolicy = field(default_factory=CompactionPolicy)
    directory_cache_bytes: int = 1 << 20
    ticks_per_second: int = 1
    takeover: bool = False

    def validate(self) -> None:
        if self.directory_cache_bytes > MAX_DIRECTORY_CACHE:
            raise ResourceExhausted("directory cache bytes", self.directory_cache_bytes, MAX_DIRECTORY_CACHE)
        if not self.sync.manual and (self.sync.every_s <= 0 or self.sync.bytes <= 0):
            raise InvalidArgument("sync policy", "interval and bytes must be positive")
        if self.seal.tail_bytes <= 0 or self.seal.every_s <= 0 or not 0 < self.seal.memory_bytes <= MAX_SEAL_MEMORY:
            raise InvalidArgument("seal policy", "bytes, interval or memory out of range")
        one, two = self.compaction.l1_window, self.compaction.l2_window
        if any(not isinstance(w, int) or w >= 2**63 for w in (one, two)) or not 1 <= one <= two:
            raise InvalidArgument("compaction policy", "windows are whole seconds, 1 <= l1 <= l2")
        if self.ticks_per_second < 1:
            raise InvalidArgument("ticks_per_second", "must be positive")
