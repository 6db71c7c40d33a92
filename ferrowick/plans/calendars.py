"""Calendar windows: half-open UTC intervals with names, as rows to join with."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from dateutil import rrule
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTC = ZoneInfo("UTC")
SCHEMA = "window_id string, start timestamp, end timestamp"


@dataclass(frozen=True)
class Calendar:
    """Gregorian, fiscal (quarters and years from `first_month`) or retail 4-4-5 (years of 52 weeks from `retail_start`)."""

    kind: str = "gregorian"
    zone: str = "UTC"
    first_month: int = 1
    retail_start: date | None = None
    holidays: frozenset[date] = frozenset()


def instant(day: date, zone: str) -> datetime:
    """The start of a local day in UTC; days keep their true length over changes of the clock."""
    return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None)


def months_on(day: date, n: int) -> date:
    k = day.year * 12 + day.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def boundaries(calendar: Calendar, cadence: str, first: date, last: date) -> list[tuple[str, date, date]]:
    """(name, start, end) of each window that starts from the one that holds `first` up to `last`."""
    out = []
    if calendar.kind == "retail":
        year_start, weeks = calendar.retail_start, (4, 4, 5) * 4
        number = year_start.year
        while year_start <= last:
            at = year_start
            months = []
            for k, w in enumerate(weeks):
                months.append((f"R{number}-P{k + 1:02d}", at, at + timedelta(weeks=w)))
                at += timedelta(weeks=w)
            spans = {"monthly": months, "quarterly": [(f"R{number}-Q{q + 1}", months[3 * q][1], months[3 * q + 2][2]) for q in range(4)], "annual": [(f"R{number}", year_start, at)]}
            spans["weekly"] = [(f"R{number}-W{w + 1:02d}", year_start + timedelta(weeks=w), year_start + timedelta(weeks=w + 1)) for w in range(52)]
            out += [s for s in spans[cadence] if s[2] > first and s[1] <= last]
            year_start, number = at, number + 1
        return out
    if cadence == "daily":
        at, step, name = first, lambda d: d + timedelta(days=1), lambda d: d.isoformat()
    elif cadence == "weekly":
        at, step, name = first - timedelta(days=first.weekday()), lambda d: d + timedelta(days=7), lambda d: "{}-W{:02d}".format(*d.isocalendar()[:2])
    else:
        length = {"monthly": 1, "quarterly": 3, "annual": 12}[cadence]
        begin = calendar.first_month if calendar.kind == "fiscal" else 1
        at = months_on(first, -((first.month - begin) % length))
        step = lambda d: months_on(d, length)

        def name(d: date) -> str:
            year = d.year + (calendar.kind == "fiscal" and d.month >= begin > 1)
            letter = "FY" if calendar.kind == "fiscal" else ""
            quarter = (d.month - begin) % 12 // 3 + 1
            return {"monthly": f"{d.year}-{d.month:02d}", "quarterly": f"{letter}{year}-Q{quarter}", "annual": f"{letter}{year}"}[cadence]

    while at <= last:
        out.append((name(at), at, step(at)))
        at = step(at)
    return out


def windows(spark: SparkSession, calendar: Calendar, cadence: str, first: date, last: date) -> DataFrame:
    """One row for each window; some hundreds a year at most."""
    rows = [(n, instant(a, calendar.zone), instant(b, calendar.zone)) for n, a, b in boundaries(calendar, cadence, first, last)]
    return spark.createDataFrame(rows, SCHEMA)


def is_business_day(day: date, calendar: Calendar) -> bool:
    return day.weekday() < 5 and day not in calendar.holidays


def nth_weekdays(rule: str, first: date, last: date) -> list[date]:
    """Days by a rule such as 3WE (third Wednesday of a month) or LFR (last Friday)."""
    n, day = rule[:-2], getattr(rrule, rule[-2:])
    start = datetime(first.year, first.month, first.day)
    found = rrule.rrule(rrule.MONTHLY, dtstart=start, until=datetime(last.year, last.month, last.day), byweekday=day(-1 if n == "L" else int(n)))
    return [d.date() for d in found]


def recurrences(rule: str, first: date, last: date) -> list[date]:
    """Days by an unbounded RFC 5545 rule, counted from 2000-01-01."""
    if "COUNT" in rule or "UNTIL" in rule:
        raise ValueError("a recurrence has no end of its own")
    found = rrule.rrulestr(rule, dtstart=datetime(2000, 1, 1))
    return [d.date() for d in found.between(datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day), inc=True)]


def tiles(spark: SparkSession, days: list[date], zone: str = "UTC") -> DataFrame:
    """Windows from each day to the next."""
    return spark.createDataFrame([(a.isoformat(), instant(a, zone), instant(b, zone)) for a, b in zip(days, days[1:], strict=False)], SCHEMA)


def assign(df: DataFrame, at: str, calendar_windows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows with the window that holds them. Up to `most` windows are broadcast; more are joined by day."""
    condition = (F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))
    if calendar_windows.limit(most + 1).count() <= most:
        return df.join(F.broadcast(calendar_windows), condition)
    by_day = calendar_windows.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("INTERVAL 1 MICROSECOND")))))
    return df.withColumn("day", F.to_date(at)).join(by_day, "day").where(condition).drop("day")


def deadline(end: Column, lateness: str) -> Column:
    """When a window is sealed: its end and the time allowed to late rows."""
    return end + F.expr(f"INTERVAL {lateness}")
