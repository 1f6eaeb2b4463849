"""Scalar expressions on release titles, months and ten-day windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three windows of a month.
WINDOWS = ("1-10", "11-20", "21-end")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def is_month(value: Column) -> Column:
    """Whether a string is a month literal YYYY-MM."""
    return value.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def shift_month(month: Column, n) -> Column:
    return F.date_format(F.add_months(month_start(month), n), "yyyy-MM")


def month_number(month: Column) -> Column:
    """Months since year 0, for calendar ranges."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def window_name(ord: Column) -> Column:
    return F.when(ord == 1, WINDOWS[0]).when(ord == 2, WINDOWS[1]).otherwise(WINDOWS[2])


def window_ord(window: Column) -> Column:
    return F.when(window == WINDOWS[0], 1).when(window == WINDOWS[1], 2).when(window == WINDOWS[2], 3)


def window_start(month: Column, ord: Column) -> Column:
    return F.date_add(month_start(month), F.when(ord == 1, 0).when(ord == 2, 10).otherwise(20))


def window_end(month: Column, ord: Column) -> Column:
    """Last day of a ten-day window; the third runs to the month's end."""
    start = month_start(month)
    return F.when(ord == 1, F.date_add(start, 9)).when(ord == 2, F.date_add(start, 19)).otherwise(F.last_day(start))


def window_midpoint(month: Column, ord: Column) -> Column:
    start = window_start(month, ord)
    return F.date_add(start, F.floor(F.datediff(window_end(month, ord), start) / 2).cast("int"))


def release_id(month: Column, window: Column, published_at: Column) -> Column:
    return F.concat_ws(":", month, window, F.date_format(published_at, "yyyy-MM-dd HH:mm:ss"))


def release_url(month: Column, ord: Column, snapshot: Column) -> Column:
    return F.concat(F.lit("https://stats.example.org/release/"), F.concat_ws("/", month, ord.cast("string"), snapshot))


def title_month_window(title: Column) -> tuple[Column, Column]:
    """(month, window) of a release title such as "prices 2024-07 (11-20)"; dashes of any kind, months of one digit."""
    plain = F.regexp_replace(title, "[‐-―−－]", "-")
    year, month = F.regexp_extract(plain, r"(\d{4})\s*[-./年]\s*(\d{1,2})", 1), F.regexp_extract(plain, r"(\d{4})\s*[-./年]\s*(\d{1,2})", 2)
    window = F.regexp_extract(plain, r"\b(1-10|11-20|21-(?:end|28|29|30|31))\b", 1)
    window = F.when(window.startswith("21-"), F.lit(WINDOWS[2])).otherwise(F.nullif(window, F.lit("")))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"))), window


def surrogate_id(name: Column, unit: Column) -> Column:
    """p_ and 16 hex digits of the quoted, white-space-free name and unit."""
    strip = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.concat(F.lit("p_"), F.substring(F.sha2(F.concat(F.lit('"'), strip(name), F.lit("|"), strip(unit), F.lit('"')), 256), 1, 16))


def json_safe(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def month_name(month: Column) -> Column:
    return F.date_format(month_start(month), "MMMM yyyy")


def regime(actual: Column) -> Column:
    return F.when(actual >= 0.5, "rising").when(actual <= -0.5, "falling").otherwise("stable")


def allowed_url(url: Column, host: str, prefix: str) -> Column:
    """Whether a URL is on the host and below the path prefix."""
    return F.coalesce((F.try_parse_url(url, F.lit("HOST")) == host) & F.try_parse_url(url, F.lit("PATH")).startswith(prefix), F.lit(False))


PUBLISHER = dt.timezone(dt.timedelta(hours=8))


def parse_as_of(text: str) -> dt.datetime:
    """A cutoff as the publisher's time (+08:00); without a time zone it is refused."""
    at = dt.datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("as_of needs a time zone")
    return at.astimezone(PUBLISHER)


def default_month(now: Column) -> Column:
    """The publisher's month at a UTC time."""
    return F.date_format(now + F.expr("INTERVAL '8' HOUR"), "yyyy-MM")


def category_name(category: Column) -> Column:
    """A category without the ordinal that it begins with."""
    return F.regexp_replace(category, r"^(?:[一二三四五六七八九十]+、|[IVX]+\. )", "")


def event_content() -> Column:
    """A journal event's own columns as one string."""
    return F.concat_ws("|", "sequence", "kind", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "key", "cycle_id", "payload")


def event_digest() -> Column:
    """What a journal event's id must be: a digest over the id before it and its own columns, so that no event can be
    rewritten without all ids after it."""
    return F.sha2(F.concat_ws("|", F.coalesce("previous_event", F.lit("")), event_content()), 256)
