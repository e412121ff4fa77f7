"""Checks of a request, made before any job starts."""

from __future__ import annotations

from ..errors import InvalidArgument, ResourceExhausted
from ..model import MAX_SLOTS


def check_range(start: int, end: int, floor: int | None = None) -> None:
    if start > end:
        raise InvalidArgument("range", f"start {start} is after end {end}")
    check_floor(start, floor)


def check_floor(at: int, floor: int | None) -> None:
    if floor is not None and at < floor:
        raise InvalidArgument("time", f"{at} lies before the retention floor {floor}")


def check_step(step: int, name: str) -> None:
    if step <= 0:
        raise InvalidArgument(name, "must be positive")


def slots(start: int, end: int, step: int, n_keys: int) -> int:
    """Slots a key needs; all keys together may need ``MAX_SLOTS``."""
    n = -(-(end - start) // step)
    if n * n_keys > MAX_SLOTS:
        raise ResourceExhausted("slots", n * n_keys, MAX_SLOTS)
    return n


def prune(units: list[dict], low: int | None, high: int | None, tables: set[int] | None = None) -> list[dict]:
    """Units in which one of ``tables`` (None: any) has facts that may lie in [low, high), oldest first."""

    def meets(a: int, b: int) -> bool:
        return (high is None or a < high) and (low is None or b >= low)

    spans = lambda u: [(u["min_ts"], u["max_ts"])] if tables is None else [u["tables"][str(t)] for t in tables if str(t) in u["tables"]]
    return sorted((u for u in units if any(meets(*s) for s in spans(u))), key=lambda u: u["min_ts"])
