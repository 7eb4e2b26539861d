"""Windows by count, and splitting at separators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowseq.flow import recorded
from flowseq.order import OrderSpec
from flowseq.plans.layout import Layout


class Windows:
    @recorded
    def window(self, size: int, step: int | None = None, fn: Callable[[Any], Column] | None = None, name: str = "window", **named: Callable[[Any], Column]):
        """Windows of ``size`` elements that begin every ``step`` elements.

        Full windows, then at most one shorter one: what is left where the next window
        would begin, provided an element came after the last full window (or there was
        none).  The elements become an array, or aggregates given by name.
        """
        step = size if step is None else step
        if size <= 0 or step <= 0:
            raise ValueError("size and step must be positive")
        base = self.guarded()
        order = base.need_order("window")
        pos, k, n = base.fresh("pos", "w", "n")
        df = Layout(base.frame, order, base.keys).index(pos)
        if step > size:
            df = df.where(F.col(pos) % step < size)
        last = F.floor(F.col(pos) / step)
        first = F.greatest(F.lit(0), F.ceil((F.col(pos) - size + 1) / F.lit(step)))
        # Tumbling windows hold each element once; others repeat it size / step times.
        df = df.withColumn(k, last.cast("long")) if size <= step else df.withColumn(k, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        columns = {x: f(base.element) for x, f in named.items()}
        if not named:
            value = fn(base.element) if fn else base.value_struct()
            columns[name] = F.transform(F.array_sort(F.array_agg(F.struct(F.col(pos).alias("p"), value.alias("v")))), lambda x: x["v"])
        held, top = base.fresh("h", "t")
        out = df.groupBy(*base.keys, k).agg(*[c.alias(x) for x, c in columns.items()], F.count(F.lit(1)).alias(held), F.max(pos).alias(top))
        if step < size:
            # A short window stays only if it is the first short one and the last full one missed something:
            # both follow from the window before it, which is full and ends before this one's last element.
            total = base.frame.groupBy(*base.keys).agg(F.count(F.lit(1)).alias(n)) if base.keys else base.frame.agg(F.count(F.lit(1)).alias(n))
            if base.keys:
                out = out.join(total, list(base.keys))
                length = F.col(n)
            else:
                length = total.scalar()
            full = F.when(length < size, F.lit(0)).otherwise(F.floor((length - size) / F.lit(step)) + 1)
            out = out.where((F.col(k) < full) | ((F.col(k) == full) & ((full == 0) | (length > (full - 1) * step + size))))
        out = out.select(*base.keys, k, *columns)
        return base.like(out, columns=tuple(columns), order=OrderSpec(((k, True),)))

    @recorded
    def split(self, separator: Callable[[Any], Column], fn: Callable[[Any], Column] | None = None, name: str = "run", **named: Callable[[Any], Column]):
        """Runs of elements between separators, as arrays or as aggregates given by name; no empty runs."""
        base = self.guarded()
        order = base.need_order("split")
        (run,) = base.fresh("run")
        is_separator = base.condition(separator)
        df = Layout(base.frame, order, base.keys).running_sum(F.when(is_separator, 1).otherwise(0).cast("long"), run)
        inner = base.like(df.where(~is_separator))._uniform() if not named else base.like(df.where(~is_separator))
        columns = {x: f(inner.element) for x, f in named.items()} or {name: inner.collected(fn)}
        out = inner.frame.groupBy(*inner.keys, run).agg(*[c.alias(x) for x, c in columns.items()])
        return inner.like(out, columns=tuple(columns), order=OrderSpec(((run, True),)))

    @recorded
    def split_text(self, pattern: str, fn: Callable[[Any], Column] = lambda e: e, name: str = "value", keep: tuple[str, ...] = ()):
        """W5 over the characters of a text column: its non-empty parts between matches of ``pattern``."""
        return self.flatmap(lambda e: F.split(fn(e), pattern, -1), name, keep)._present(name)


