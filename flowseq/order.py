"""Order as metadata: which columns, in which direction, put a flow's rows in sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class OrderRequired(ValueError):
    """An operator that depends on position was applied to a flow without an order."""


@dataclass(frozen=True)
class OrderSpec:
    """Columns that together are unique, most significant first, each ascending or not."""

    keys: tuple[tuple[str, bool], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.keys)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.keys]

    def columns(self, reverse: bool = False) -> list[Column]:
        """Sort expressions; nulls come first in ascending order."""
        return [F.col(n).asc_nulls_first() if up != reverse else F.col(n).desc_nulls_last() for n, up in self.keys]

    def reversed(self) -> OrderSpec:
        return OrderSpec(tuple((n, not up) for n, up in self.keys))

    def prefixed(self, *keys: tuple[str, bool]) -> OrderSpec:
        return OrderSpec(keys + self.keys)

    def then(self, *keys: tuple[str, bool]) -> OrderSpec:
        return OrderSpec(self.keys + keys)

    def direction(self) -> bool | None:
        """True if all keys ascend, False if all descend, None if they are mixed."""
        ups = {up for _, up in self.keys}
        return ups.pop() if len(ups) == 1 else None

    def key(self) -> Column:
        """All keys as one struct."""
        return F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(self.names)])

    def before(self, other: Column) -> Column:
        """Whether a row stands before the position ``other``, a struct like :meth:`key`."""
        result = F.lit(False)
        for i, (name, up) in reversed(list(enumerate(self.keys))):
            mine, theirs = F.col(name), other[f"k{i}"]
            less = F.coalesce(mine < theirs if up else mine > theirs, mine.isNull() & theirs.isNotNull() if up else mine.isNotNull() & theirs.isNull())
            result = less | (mine.eqNullSafe(theirs) & result)
        return result

    def same(self, other: Column) -> Column:
        result = F.lit(True)
        for i, name in enumerate(self.names):
            result = result & F.col(name).eqNullSafe(other[f"k{i}"])
        return result
