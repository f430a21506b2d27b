"""Trading calendar of the New York exchange, 2021 to 2030, from a table of rules."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession

FIRST, LAST, OPEN, CLOSE, EARLY = 2021, 2030, 570, 960, 780
DAY = timedelta(days=1)
#: Month, day or (ordinal, weekday with Monday 0), first year. Ordinal -1 is the last one of the month.
HOLIDAYS = [
    (1, 1, 0), (1, (3, 0), 0), (2, (3, 0), 0), (5, (-1, 0), 0), (6, 19, 2022), (7, 4, 0), (9, (1, 0), 0), (11, (4, 3), 0), (12, 25, 0),
]
SPECIAL = {date(2025, 1, 9)}


def weekday_of(year: int, month: int, ordinal: int, weekday: int) -> date:
    days = [d for d in (date(year, month, 1) + k * DAY for k in range(31)) if d.month == month and d.weekday() == weekday]
    return days[ordinal - 1 if ordinal > 0 else ordinal]


def easter(year: int) -> date:
    """Easter Sunday by Gauss's rule for the Gregorian calendar."""
    k = year // 100
    m = (15 - (13 + 8 * k) // 25 + k - k // 4) % 30
    d = (19 * (year % 19) + m) % 30
    e = (2 * (year % 4) + 4 * (year % 7) + 6 * d + (4 + k - k // 4) % 7) % 7
    offset = d + e
    if d == 29 and e == 6 or d == 28 and e == 6 and (11 * m + 11) % 30 < 19:
        offset -= 7
    return date(year, 3, 22) + offset * DAY


def moved(d: date) -> date:
    """A fixed holiday on Saturday is kept on Friday, one on Sunday on Monday."""
    return d + {5: -DAY, 6: DAY}.get(d.weekday(), 0 * DAY)


@cache
def holidays(year: int) -> frozenset[date]:
    """The closures that belong to a year; one moved out of it doesn't close the other year's day."""
    if not FIRST <= year <= LAST:
        raise ValueError(f"the calendar covers {FIRST} to {LAST}, not {year}")
    found = {moved(date(year, m, d)) if isinstance(d, int) else weekday_of(year, m, *d) for m, d, since in HOLIDAYS if year >= since}
    return frozenset(found | {easter(year) - 2 * DAY} | {d for d in SPECIAL if d.year == year})


@cache
def half_days(year: int) -> frozenset[date]:
    eves = [date(year, m, d) - DAY for m, d in ((7, 4), (12, 25)) if date(year, m, d).weekday() < 5]
    eves.append(weekday_of(year, 11, 4, 3) + DAY)
    return frozenset(d for d in eves if d.weekday() < 5 and d not in holidays(year))


def is_trading_day(d: date) -> bool:
    return d.weekday() < 5 and d not in holidays(d.year)


def session_end(d: date) -> int:
    """Minutes after midnight."""
    holidays(d.year)
    return EARLY if d in half_days(d.year) else CLOSE


def calendar(spark: SparkSession) -> DataFrame:
    """(date, session_end) of all trading days: ten years of rows."""
    days = [date(FIRST, 1, 1) + k * DAY for k in range((date(LAST + 1, 1, 1) - date(FIRST, 1, 1)).days)]
    return spark.createDataFrame([(d, session_end(d)) for d in days if is_trading_day(d)], "date date, session_end int")
