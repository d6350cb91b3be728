"""Vendor dates.  Everything is UTC, without a zone, and 'now' is an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def from_epoch(n: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart by size."""
    n = n.cast("double")
    millis = F.when(n < 1e12, n * 1000).otherwise(n)
    return _ntz(F.timestamp_millis(millis.cast("bigint")))


def from_text(s: Column) -> Column:
    """ISO dates, with or without time and zone; anything else is NULL."""
    t = F.trim(s)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?( ?(Z|[+-]\d{2}:?\d{2}))?\z")
    zoned = F.regexp_replace(F.regexp_replace(t, " (?=[Z+-])", ""), r"([+-]\d{2})(\d{2})\z", "$1:$2")
    long_month = F.try_to_timestamp(t, F.lit("MMMM d, yyyy"))
    short_month = F.try_to_timestamp(t, F.lit("MMM d, yyyy"))
    return F.coalesce(
        F.when(iso, _ntz(F.try_to_timestamp(zoned))), _ntz(long_month), _ntz(short_month)
    )


def start_of_day(now: Column) -> Column:
    return _ntz(F.date_trunc("DAY", now))


def age_days(posted_at: Column, now: Column) -> Column:
    """Whole days since posting, rounded down; NULL when undated."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp"))
    return F.floor(micros / DAY_MICROS).cast("bigint")


def exact_age(posted_at: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp"))
    return micros / DAY_MICROS


def days_before(now: Column, n: Column) -> Column:
    return now - F.make_dt_interval(days=n.cast("int"))


def posted_on(text: Column, now: Column) -> Column:
    """'Posted 3 Days Ago' and friends, relative to ``now``; first form wins."""
    t = F.lower(text)

    def number(pattern: str) -> Column:
        return F.regexp_extract(t, pattern, 1).try_cast("int")

    day = start_of_day(now)
    plus = number(r"(\d+)\+\s*days?")
    days = number(r"(\d+)\s*days?\s*ago")
    weeks = number(r"(\d+)\+?\s*weeks?\s*ago")
    months = number(r"(\d+)\+?\s*months?\s*ago")
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    mdy = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    us_date = F.concat_ws(
        "-",
        F.regexp_extract(t, mdy, 3),
        F.lpad(F.regexp_extract(t, mdy, 1), 2, "0"),
        F.lpad(F.regexp_extract(t, mdy, 2), 2, "0"),
    )
    iso_date = iso.try_cast("date")
    us_parsed = us_date.try_cast("date")
    return (
        F.when(t.rlike("today|just posted"), day)
        .when(t.rlike("yesterday"), days_before(day, F.lit(1)))
        .when(plus.isNotNull(), days_before(now, plus))
        .when(days.isNotNull(), days_before(now, days))
        .when(weeks.isNotNull(), days_before(day, weeks * 7))
        .when(months.isNotNull(), days_before(day, months * 30))
        .when(t.rlike(r"\d+\+?\s*hours?\s*ago"), day)
        .when(iso_date.isNotNull(), _ntz(iso_date))
        .when(us_parsed.isNotNull(), _ntz(us_parsed))
    )
