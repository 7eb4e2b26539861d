"""Where flows end on the driver or in storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(row) -> Any:
    return row[0] if len(row) == 1 else tuple(row)


class Sinks:
    def rows(self) -> Iterator[Any]:
        """Elements in order, fetched partition by partition."""
        return map(_plain, self.sorted_df().toLocalIterator())

    def foreach(self, f: Callable[[Any], None]) -> None:
        """K1: a side effect on the driver, in order."""
        for e in self.rows():
            f(e)

    def foreach_distributed(self, f: Callable[[Any], None]) -> None:
        """K1: a side effect where the rows are, in no order."""
        self.to_df().foreach(lambda row: f(_plain(row)))

    def act(self) -> None:
        """K2: run everything for its side effects and keep nothing."""
        self.frame.write.format("noop").mode("overwrite").save()

    def to(self, container: Any = list) -> Any:
        """K3, K4, K5: into a new container of a type, or into the one given."""
        if isinstance(container, type):
            return "".join(self.rows()) if container is str else dict(self.rows()) if container is dict else container(self.rows())
        add = next(getattr(container, m) for m in ("append", "add", "push", "put") if hasattr(container, m)) if not isinstance(container, dict) else lambda kv: container.__setitem__(*kv)
        self.foreach(add)
        return container

    def to_vector(self, name: str = "value"):
        """K7: one array of all elements, as a result."""
        base = self._uniform() if self.order else self
        return base.agg(**{name: base.collected()})

    def to_set(self, name: str = "value"):
        """K5, K7: one array of the distinct elements, as a result."""
        return self.agg(**{name: F.array_sort(F.collect_set(self.value_struct()))})

    def to_map(self, key: str, value: str, name: str = "value"):
        """K5: one map, as a result; of equal keys the first stays (any, in a flow without an order), null keys are left out."""
        firsts = self.filter(lambda e: F.col(key).isNotNull()).distinct(by=lambda e: F.col(key))
        return firsts.agg(**{name: F.map_from_entries(F.array_agg(F.struct(key, value)))})

    def to_iter(self, target: list, begin: int = 0, end: int | None = None) -> int:
        """K8: write over ``target[begin:end]``; the position after the last element written."""
        bounded = self.take_first((len(target) if end is None else end) - begin)
        at = begin
        for e in bounded.rows():
            target[at] = e
            at += 1
        return at

    def text(self, format: Callable[[Any], Column] | None = None, delimiter: str = ", ", start: str = "[", end: str = "]", name: str = "line"):
        """K9, K11 in the plan: all elements in one line."""
        base = self._uniform() if self.order else self
        shown = base.collected(format or (lambda e: base.value_struct().cast("string")))
        return base.agg(**{name: F.concat(F.lit(start), F.array_join(F.coalesce(shown, F.array().cast("array<string>")), delimiter), F.lit(end))})

    def print(self, delimiter: str = ", ", start: str = "[", end: str = "]\n", to: Any = None, format: Callable[[Any], str] = str) -> None:
        """Elements in order to a stream (standard output)."""
        import sys

        out = to or sys.stdout
        out.write(start)
        for i, e in enumerate(self.rows()):
            out.write((delimiter if i else "") + format(e))
        out.write(end)

    def println(self, to: Any = None, format: Callable[[Any], str] = str) -> None:
        """One element a line."""
        self.print("\n", "", "\n", to, format)

    def write(self, path: str, mode: str = "error", **options: Any) -> None:
        """Elements as Parquet, sorted by range if the flow has an order."""
        self.sorted_df().write.mode(mode).options(**options).parquet(path)
