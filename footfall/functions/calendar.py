"""Day numbers (``yyyymmdd`` ints), labelled periods and weeks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """Half-open day range ``[lo, hi)`` with a label."""

    label: str
    lo: int
    hi: int


@dataclass(frozen=True)
class Campaign:
    """The three periods around an advertising campaign, in time order."""

    before: Period
    now: Period
    after: Period

    @classmethod
    def from_days(cls, days: tuple[int, int, int, int]) -> Campaign:
        """Periods between four consecutive boundary days."""
        labels = ("before", "now", "after")
        return cls(*(Period(name, days[i], days[i + 1]) for i, name in enumerate(labels)))

    @property
    def periods(self) -> tuple[Period, Period, Period]:
        return (self.before, self.now, self.after)

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(p.label for p in self.periods)


# The campaign boundaries the original study used.
STUDY_CAMPAIGN = Campaign.from_days((20210201, 20210301, 20210329, 20210426))


def as_day(dayno: int) -> date:
    return datetime.strptime(str(dayno), "%Y%m%d").date()


def as_dayno(day: date) -> int:
    return int(day.strftime("%Y%m%d"))


def dayno_of(ts: Column) -> Column:
    """Day number of a timestamp."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def to_date(dayno: Column) -> Column:
    return F.make_date(F.floor(dayno / 10000), F.floor(dayno / 100) % 100, dayno % 100)


def in_campaign(dayno: Column, campaign: Campaign) -> Column:
    """Plain range over all periods; simple enough to be pushed into the scan."""
    return (dayno >= min(p.lo for p in campaign.periods)) & (dayno < max(p.hi for p in campaign.periods))


def period_of(dayno: Column, campaign: Campaign) -> Column:
    """Label of the period a day falls in, NULL outside all of them."""
    return F.coalesce(*(F.when((dayno >= p.lo) & (dayno < p.hi), F.lit(p.label)) for p in campaign.periods))


def snapshot_period(dayno: Column, event_day: Column, campaign: Campaign) -> Column:
    """Period read from an end-of-period snapshot that carries the day of the last event."""
    return F.coalesce(
        *(
            F.when((dayno == p.hi) & (event_day >= p.lo) & (event_day < p.hi), F.lit(p.label))
            for p in campaign.periods
        )
    )


def day_list(start: int, end: int, step: int = 1) -> list[int]:
    """Every ``step``-th day from ``start`` up to and including ``end``."""
    first, last = as_day(start), as_day(end)
    return [as_dayno(first + timedelta(days=i)) for i in range(0, (last - first).days + 1, step)]


def day_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """The same list as a one-column DataFrame, built by Spark."""
    first, last = F.lit(as_day(start)), F.lit(as_day(end))
    days = F.explode(F.sequence(first, last, F.expr(f"interval {int(step)} days")))
    return spark.range(1).select(days.alias("day")).select(dayno_of(F.col("day")).alias("dayno"))


@dataclass(frozen=True)
class Weeks:
    """``n`` complete weeks from day ``start`` on."""

    start: int
    n: int

    @classmethod
    def between(cls, start: int, end: int) -> Weeks:
        """The complete weeks inside ``[start, end]``."""
        return cls(start, ((as_day(end) - as_day(start)).days + 1) // 7)

    @property
    def bounds(self) -> list[tuple[int, int]]:
        first = as_day(self.start)
        return [
            (as_dayno(first + timedelta(days=7 * i)), as_dayno(first + timedelta(days=7 * i + 6)))
            for i in range(self.n)
        ]

    @property
    def last_day(self) -> int:
        return self.bounds[-1][1]

    def contains(self, dayno: Column) -> Column:
        return dayno.between(self.start, self.last_day)

    def index(self, dayno: Column) -> Column:
        """0-based week number of a day inside the range."""
        return F.floor(F.datediff(to_date(dayno), F.lit(as_day(self.start))) / 7).cast("int")

    def label(self, week: Column) -> Column:
        """``first~last`` day numbers of a 0-based week number."""
        first = F.date_add(F.lit(as_day(self.start)), (week * 7).cast("int"))
        text = [F.date_format(d, "yyyyMMdd") for d in (first, F.date_add(first, 6))]
        return F.concat_ws("~", *text)


# The two week ranges the original study used.
ACTIVITY_WEEKS = Weeks.between(20210301, 20210829)
PLACE_WEEKS = Weeks.between(20201101, 20210331)

