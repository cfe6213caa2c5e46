"""Public holidays by rule, for the countries of the sites."""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The country of each site; sites not listed are in the US.
SITE_COUNTRY = {
    0: "US", 1: "UK", 2: "US", 3: "US", 4: "US", 5: "UK", 6: "US", 7: "CA",
    8: "US", 9: "US", 10: "US", 11: "CA", 12: "IE", 13: "US", 14: "US", 15: "US",
}
DEFAULT_COUNTRY = "US"

MON, THU, FRI, SAT, SUN = 0, 3, 4, 5, 6


def easter(year: int) -> date:
    """Easter Sunday (Gregorian computus)."""
    golden = year % 19
    century, rest = divmod(year, 100)
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    shift = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    late = (golden + 11 * moon + 22 * shift) // 451
    month, day = divmod(moon + shift - 7 * late + 114, 31)
    return date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 is the last one."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year + month // 12, month % 12 + 1, 1)) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def _us(year: int) -> set[date]:
    fixed = [date(year, 1, 1), date(year, 7, 4), date(year, 11, 11), date(year, 12, 25)]
    if year >= 2021:
        fixed.append(date(year, 6, 19))
    floating = [
        nth_weekday(year, 1, MON, 3),
        nth_weekday(year, 2, MON, 3),
        nth_weekday(year, 5, MON, -1),
        nth_weekday(year, 9, MON, 1),
        nth_weekday(year, 10, MON, 2),
        nth_weekday(year, 11, THU, 4),
    ]
    # a Saturday holiday is also kept on Friday, a Sunday holiday on Monday
    observed = [d - timedelta(days=1) for d in [*fixed, date(year + 1, 1, 1)] if d.weekday() == SAT]
    observed += [d + timedelta(days=1) for d in fixed if d.weekday() == SUN]
    return {d for d in [*fixed, *floating, *observed] if d.year == year}


def _next_free(days: list[date]) -> set[date]:
    """Add a substitute on the next free weekday for each day that falls on a weekend."""
    out = set(days)
    for d in sorted(days):
        if d.weekday() >= SAT:
            substitute = d
            while substitute.weekday() >= SAT or substitute in out:
                substitute += timedelta(days=1)
            out.add(substitute)
    return out


def _uk(year: int) -> set[date]:
    days = _next_free([date(year, 1, 1), date(year, 12, 25), date(year, 12, 26)])
    days |= {easter(year) - timedelta(days=2), nth_weekday(year, 5, MON, 1), nth_weekday(year, 5, MON, -1)}
    # fixed values: years in which a bank holiday was moved or added
    moved = {
        1995: ({date(1995, 5, 1)}, {date(1995, 5, 8)}),
        2002: ({date(2002, 5, 27)}, {date(2002, 6, 3), date(2002, 6, 4)}),
        2011: (set(), {date(2011, 4, 29)}),
        2012: ({date(2012, 5, 28)}, {date(2012, 6, 4), date(2012, 6, 5)}),
        2020: ({date(2020, 5, 4)}, {date(2020, 5, 8)}),
        2022: ({date(2022, 5, 30)}, {date(2022, 6, 2), date(2022, 6, 3), date(2022, 9, 19)}),
        2023: (set(), {date(2023, 5, 8)}),
    }
    gone, added = moved.get(year, (set(), set()))
    return (days - gone) | added | ({date(1999, 12, 31)} if year == 1999 else set())


def _ca(year: int) -> set[date]:
    days = {
        date(year, 1, 1),
        easter(year) - timedelta(days=2),
        date(year, 7, 1),
        nth_weekday(year, 9, MON, 1),
        date(year, 12, 25),
    }
    return days


def _ie(year: int) -> set[date]:
    days = {
        date(year, 1, 1),
        date(year, 3, 17),
        easter(year) + timedelta(days=1),
        nth_weekday(year, 5, MON, 1),
        nth_weekday(year, 6, MON, 1),
        nth_weekday(year, 8, MON, 1),
        nth_weekday(year, 10, MON, -1),
        date(year, 12, 25),
        date(year, 12, 26),
    }
    if year == 1999:
        days.add(date(1999, 12, 31))
    if year == 2022:
        days.add(date(2022, 3, 18))
    if year >= 2023:
        feb = date(year, 2, 1)
        days.add(feb if feb.weekday() == FRI else nth_weekday(year, 2, MON, 1))
    return days


RULES = {"US": _us, "UK": _uk, "CA": _ca, "IE": _ie}


def country_holidays(country: str, year: int) -> set[date]:
    return RULES[country](year)


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(country, day) of every holiday: about a dozen days per country and year."""
    rows = [
        (country, day)
        for country in RULES
        for year in range(first_year, last_year + 1)
        for day in sorted(country_holidays(country, year))
    ]
    # through Arrow the rows become part of the plan and need no job
    table = pa.table({"holiday_country": [c for c, _ in rows], "holiday_day": pa.array([d for _, d in rows], pa.date32())})
    return spark.createDataFrame(table)
