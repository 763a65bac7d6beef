"""Next run times and daily windows as column expressions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def next_on_grid(anchor: Column, every_seconds: Column, after: Column) -> Column:
    """The first time after ``after`` on the grid from ``anchor``; the anchor if it is still to come."""
    a, t, step = F.unix_micros(anchor), F.unix_micros(after), every_seconds.cast("long") * 1_000_000
    return F.when(t < a, anchor).when(step > 0, F.timestamp_micros(a + F.floor((t - a) / step + 1).cast("long") * step))


def next_daily(second_of_day: Column, after: Column) -> Column:
    """The next time of day after ``after``, in the session's time zone."""
    today = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", after)) + second_of_day)
    return F.when(today > after, today).otherwise(today + F.expr("interval 1 day"))


def next_weekly(iso_day: Column, second_of_day: Column, after: Column) -> Column:
    """The next such time on a day of the week (1 is Monday) after ``after``."""
    ahead = (iso_day - (F.weekday(after) + 1) + 7) % 7
    run = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", after)) + ahead * DAY + second_of_day)
    return F.when(run > after, run).otherwise(run + F.expr("interval 7 days"))


def within_hours(ts: Column, window: str | None) -> Column:
    """Whether the minute of ``ts`` is in ``HH:MM-HH:MM``, which may wrap midnight;
    always so for none, a malformed window, or the whole day."""
    try:
        begin, end = (int(h) * 60 + int(m) for h, m in (x.strip().split(":") for x in (window or "").split("-")))
    except ValueError:
        return F.lit(True)
    if not (0 <= begin < 1440 and 0 <= end < 1440) or (begin, end) == (0, 1439):
        return F.lit(True)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= begin) & (minute < end) if begin <= end else (minute >= begin) | (minute < end)


#: Names that cron fields may use (fixed values).
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
#: Days that are looked at before an expression counts as never met.
CRON_DAYS = 1500


def cron_values(field: str, low: int, high: int, names: tuple[str, ...] = ()) -> list[int]:
    """The numbers that a cron field stands for: ``*``, ``a``, ``a-b``, with a step
    ``/n`` (``a/n`` runs to the end), in lists. Anything else is an error."""

    def atom(text: str) -> int:
        text = text.strip().upper()
        value = low + names.index(text) if text in names else int(text) if text.isascii() and text.isdigit() else -1
        if not low <= value <= high:
            raise ValueError(f"cron value {text!r} is not in {low}-{high}")
        return value

    found: set[int] = set()
    for part in (field or "").split(","):
        body, slash, by = part.strip().partition("/")
        if slash and not (by.isascii() and by.isdigit() and int(by) > 0):
            raise ValueError(f"cron step {by!r}")
        step = int(by) if slash else 1
        if body == "*":
            first, last = low, high
        elif "-" in body:
            first, last = (atom(x) for x in body.split("-", 1))
        else:
            first = atom(body)
            last = high if step > 1 else first
        if first > last:
            raise ValueError(f"cron range {body!r} runs backwards")
        found |= set(range(first, last + 1, step))
    return sorted(found)


def next_cron(cron: str, after: Column) -> Column:
    """The first minute after ``after`` that the expression names, in the session's
    time zone; null if there is none within ``CRON_DAYS`` days.

    Five fields (minute, hour, day, month, day of the week), or six of which the
    last, seconds, is left out. If both day fields are restricted, either will do.
    The days to come are looked at in three steps: the next week, then two months, and
    then the days of such months as the expression names. Of a day only its first time
    counts, except of the day of ``after``, whose next time is looked up by the minute.
    """
    fields = cron.split()
    fields = fields[:5] if len(fields) == 6 else fields
    if len(fields) != 5:
        raise ValueError(f"a cron expression has 5 fields: {cron!r}")
    minutes, hours = cron_values(fields[0], 0, 59), cron_values(fields[1], 0, 23)
    days, months = cron_values(fields[2], 1, 31), cron_values(fields[3], 1, 12, MONTHS)
    weekdays = sorted({v % 7 for v in cron_values(fields[4], 0, 7, WEEKDAYS)})
    any_day, any_weekday = fields[2] == "*", fields[4] == "*"

    def fits(d: Column) -> Column:
        by_day, by_weekday = F.dayofmonth(d).isin(days), ((F.weekday(d) + 1) % 7).isin(weekdays)
        right = F.lit(True) if any_day and any_weekday else by_weekday if any_day else by_day if any_weekday else by_day | by_weekday
        return right & F.month(d).isin(months)

    times = [h * 60 + m for h in hours for m in minutes]
    # The first time from each minute of a day on.
    since = F.lit([next((t for t in times if t >= m), -1) for m in range(1440)])
    at = lambda d, minute: F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + minute * 60)
    today = F.to_date(after)
    gone = F.floor((F.unix_micros(after) - F.unix_micros(today.cast("timestamp"))) / F.lit(60_000_000)).cast("int")
    left = F.nullif(F.get(since, gone + 1), F.lit(-1))
    days_from = lambda low, high: F.filter(F.sequence(F.date_add(today, low), F.date_add(today, high)), fits)
    month_starts = F.sequence(F.trunc(F.date_add(today, 63), "month").cast("date"), F.date_add(today, CRON_DAYS), F.expr("interval 1 month"))
    in_months = F.flatten(F.transform(F.filter(month_starts, lambda d: F.month(d).isin(months)), lambda d: F.sequence(d, F.last_day(d))))
    far = F.filter(in_months, lambda d: fits(d) & (d >= F.date_add(today, 63)) & (d <= F.date_add(today, CRON_DAYS)))
    later = F.coalesce(*[F.get(x, F.lit(0)) for x in (days_from(1, 7), days_from(8, 62), far)])
    return F.coalesce(F.when(fits(today), at(today, left)), at(later, F.lit(times[0])))


def known_zone(zone: Column) -> Column:
    """The name of a time zone without blanks around it; UTC for none, null for a name
    that no zone has."""
    bare = F.nullif(F.btrim(zone), F.lit(""))
    return F.when(bare.isNull(), "UTC").when(bare.isin(*sorted(available_timezones())), bare)


def time_of_day(text: Column) -> Column:
    """Seconds from midnight of ``HH:MM`` or ``HH:MM:SS``; null for anything else."""
    bare = F.btrim(text)
    part = lambda n: F.coalesce(F.try_element_at(F.split(bare, ":"), F.lit(n)).cast("int"), F.lit(0))
    fits = bare.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$")
    return F.when(fits, part(1) * 3600 + part(2) * 60 + part(3))


#: Names and numbers of the days of the week, Monday first (fixed values).
DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def day_of_week(text: Column) -> Column:
    """1 (Monday) to 7 of a name, its first three letters, or a number (0 is Sunday too)."""
    low = F.lower(F.btrim(text))
    named = F.coalesce(*[F.when(low.isin(name, name[:3], str(n)), F.lit(n)) for n, name in enumerate(DAY_NAMES, 1)])
    return F.when(low == "0", 7).otherwise(named)


def next_run(kind: Column, schedule: Column, zone: Column, after: Column, crons: tuple[str, ...] = ()) -> Column:
    """When a task runs next after ``after``; null if never, or if what it needs is missing.

    ``kind`` is once, interval, daily, weekly or cron; ``schedule`` is JSON: run_at; one of
    every_seconds, every_minutes and every_hours, with anchor_at; time; time and weekday;
    or cron, one of the expressions ``crons`` that a plan may have. Times of day and cron
    are those of the zone. The session's own zone must be UTC.
    """
    kind, zone = F.lower(F.btrim(kind)), known_zone(zone)
    field = lambda name: F.nullif(F.get_json_object(schedule, f"$.{name}"), F.lit(""))
    local = F.from_utc_timestamp(after, zone)
    back = lambda t: F.to_utc_timestamp(t, zone)
    once = F.try_to_timestamp(field("run_at"))
    number = lambda name, by: F.coalesce(field(name).try_cast("long"), F.lit(0)) * by
    every = F.coalesce(*[F.when(number(name, by) > 0, number(name, by)) for name, by in (("every_seconds", 1), ("every_minutes", 60), ("every_hours", 3600))])
    anchor = F.coalesce(F.try_to_timestamp(field("anchor_at")), after)
    at = time_of_day(field("time"))
    today = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", local)) + at)
    daily = F.when(back(today) > after, back(today)).otherwise(back(today + F.expr("interval 1 day")))
    weekly = back(next_weekly(day_of_week(field("weekday")), at, local))
    named = [F.when(F.btrim(field("cron")) == cron, back(next_cron(cron, local))) for cron in crons]
    return (
        F.when(kind == "once", F.when(once > after, once)).when(kind == "interval", F.when(every > 0, next_on_grid(anchor, every, after)))
        .when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "cron", F.coalesce(*named) if named else F.lit(None).cast("timestamp"))
    )
