"""A year's calendar as text: runs of days, windows of months, formatted lines."""

from __future__ import annotations

import calendar as python_calendar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import flowseq as fs

DAY, WEEKS = 3, 6
WIDTH = 7 * DAY
GAP = "     "
HEAD = "".join(f"{name:>{DAY}}" for name in ("Su", "Mo", "Tu", "We", "Th", "Fr", "Sa"))


def months(spark: SparkSession, year: int) -> fs.Flow:
    """``name, page``: each month's days in one string of six weeks, blanks where no day is."""
    day = fs.generate(spark, lambda i: F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), i.cast("int"))).until(lambda d: F.year(d) > year)
    dated = day.map(lambda d: {"first": F.trunc(d, "month"), "cell": F.lpad(F.dayofmonth(d).cast("string"), DAY, " ")})
    cells = dated.groupby(lambda e: {"first": e.first}).valueby(lambda e: e.cell).adjacent().to_vector("cells")
    # Weeks begin on Sunday: the cells before a month's first day are blank.
    page = lambda e: F.concat(F.repeat(F.lit(" " * DAY), F.dayofweek(e.first) - 1), F.array_join(e.cells, ""))
    return cells.map(lambda e: {"name": F.date_format(e.first, "MMM"), "page": F.rpad(page(e), WEEKS * WIDTH, " ")})


def calendar(spark: SparkSession, year: int, per_row: int = 3) -> fs.Flow:
    """``text``: the lines of the calendar, ``per_row`` months side by side."""
    rows = months(spark, year).window(per_row, fn=lambda e: F.struct(e.name.alias("name"), e.page.alias("page")), name="shown")
    title = lambda m: F.rpad(F.lpad(m["name"], (WIDTH + DAY) // 2, " "), WIDTH, " ")
    week = lambda k: (lambda m: F.substring(m["page"], k * WIDTH + 1, WIDTH))
    lines = [title, lambda m: F.lit(HEAD), *map(week, range(WEEKS))]
    return rows.flatmap(lambda shown: F.array(*[F.array_join(F.transform(shown, line), GAP) for line in lines]), "text")


def plain_lines(year: int, per_row: int = 3) -> list[str]:
    """The same lines from Python's calendar: what the query has to equal."""
    out = []
    for at in range(1, 13, per_row):
        row = range(at, min(at + per_row, 13))
        out.append(GAP.join(f"{python_calendar.month_abbr[m]:^{WIDTH}}" for m in row))
        out.append(GAP.join(HEAD for _ in row))
        weeks = [python_calendar.Calendar(6).monthdayscalendar(year, m) for m in row]
        out += [GAP.join("".join(f"{d or '':>{DAY}}" for d in (w[k] if k < len(w) else [0] * 7)) for w in weeks) for k in range(WEEKS)]
    return out


def ex_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of 2024 with line numbers."""
    return calendar(spark, 2024).zip_with_index("line").to_df()


CALENDAR_SQL = f"SELECT CAST(line AS BIGINT) AS line, text FROM (VALUES {', '.join(f'({i}, {t!r})' for i, t in enumerate(plain_lines(2024)))}) t(line, text)"
