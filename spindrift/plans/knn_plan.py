"""Which k a nearest-neighbour query uses, and which of its predicates run before the search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

#: Neighbours where no limit can be used as k.
DEFAULT_K = 100
MAX_K = 2**31 - 1
_PUSHED = ("=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None

    def sql(self) -> str:
        if self.op.upper() in ("IS NULL", "IS NOT NULL"):
            return f"`{self.column}` {self.op}"
        if isinstance(self.value, str):
            shown = "'" + self.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        else:
            shown = "NULL" if self.value is None else repr(self.value)
        return f"`{self.column}` {self.op} {shown}"


@dataclass(frozen=True)
class KnnPlan:
    #: None: every row.
    k: int | None
    before: tuple[Predicate, ...]
    after: tuple[Predicate, ...]
    order_by: tuple[tuple[str, bool], ...]
    limit: int | None
    offset: int


def plan(metadata: Sequence[str], where: Sequence[Predicate] = (), limit: int | None = None, order_by: Sequence[tuple[str, bool]] = (), offset: int = 0) -> KnnPlan:
    """``order_by``: (column, ascending) pairs.

    Comparisons of metadata columns run before the search. A limit becomes k only where nothing after the search could
    change which rows it takes: no other predicate, and no order but ascending distance; otherwise k is DEFAULT_K, and the
    rest runs on those neighbours. An offset adds to k. A negative limit takes all rows.
    """
    before = tuple(p for p in where if p.op in _PUSHED and p.column in metadata)
    after = tuple(p for p in where if p not in before)
    plain = not after and (not order_by or list(order_by) == [("distance", True)])
    if limit is None:
        return KnnPlan(DEFAULT_K, before, after, tuple(order_by), None, offset)
    if limit < 0 and plain:
        return KnnPlan(None, before, after, tuple(order_by), None, offset)
    if plain:
        k = limit + offset
        return KnnPlan(k if k <= MAX_K else None, before, after, tuple(order_by), limit if limit <= MAX_K else None, offset)
    return KnnPlan(DEFAULT_K, before, after, tuple(order_by), None if limit < 0 else limit, offset)
