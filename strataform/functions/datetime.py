"""Dates, times and durations. Times without zone; a duration is a day-time interval of at most 838:59:59."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.functions.core import add


def seconds(ts):
    return F.unix_seconds(ts.cast("timestamp"))


def from_seconds(n):
    return F.timestamp_seconds(n).cast("timestamp_ntz")


def floor_to(step: int):
    return lambda ts: from_seconds(F.floor(seconds(ts) / step) * step)


def span(days=None, hours=None, minutes=None, secs=None):
    zero = F.lit(0)
    return F.make_dt_interval(*[zero if x is None else x for x in (days, hours, minutes, secs)])


def add_months(ts, n):
    """Keeps the time of day; the day is cut to the month's last."""
    return F.add_months(ts.cast("date"), n).cast("timestamp_ntz") + (ts - F.date_trunc("DAY", ts))


def diff(unit: str):
    """Whole units from the first to the second, cut toward zero."""
    return lambda a, b: F.timestamp_diff(unit, a, b)


def months_between(a, b):
    """Whole months from a to b, cut toward zero: a month is whole once day and time of day are reached."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    place = [F.date_format(c, "ddHHmmssSSSSSS") for c in (a, b)]
    return months - F.when((a <= b) & (place[1] < place[0]), 1).when((a > b) & (place[1] > place[0]), -1).otherwise(0)


def timestamp_diff(unit: str):
    per = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}.get(unit)
    return (lambda a, b: (months_between(a, b) / per).cast("long")) if per else diff(unit)


def week_number(d):
    return F.floor((F.unix_date(d) + 3) / 7)


#: Composite units: their parts in order, and the digits each takes.
UNITS = {
    "YEAR": "yyyy", "MONTH": "MM", "DAY": "dd", "HOUR": "HH", "MINUTE": "mm", "SECOND": "ss", "MICROSECOND": "SSSSSS",
    "YEAR_MONTH": "yyyyMM", "DAY_HOUR": "ddHH", "DAY_MINUTE": "ddHHmm", "DAY_SECOND": "ddHHmmss", "DAY_MICROSECOND": "ddHHmmssSSSSSS",
    "HOUR_MINUTE": "HHmm", "HOUR_SECOND": "HHmmss", "HOUR_MICROSECOND": "HHmmssSSSSSS", "MINUTE_SECOND": "mmss", "MINUTE_MICROSECOND": "mmssSSSSSS", "SECOND_MICROSECOND": "ssSSSSSS",
}


def extract(unit: str):
    if unit == "QUARTER":
        return F.quarter
    if unit == "WEEK":
        return F.weekofyear
    return lambda ts: F.date_format(ts, UNITS[unit]).cast("long")


def total_seconds(iv):
    return iv.cast("interval second").cast("decimal(18,6)")


def duration_part(low: int, size: int | None):
    """A part of the absolute value."""

    def build(iv):
        whole = F.floor(F.abs(total_seconds(iv)) / low).cast("long")
        return whole if size is None else whole % size

    return build


def clock(fsp: int = 0):
    """The time of the query, with so many digits of a second."""
    if not 0 <= fsp <= 6:
        raise ValueError("0 to 6 digits")
    return F.timestamp_micros(F.floor(F.unix_micros(F.current_timestamp()) / 10 ** (6 - fsp)).cast("long") * 10 ** (6 - fsp)).cast("timestamp_ntz")


add(165, "ConvertTimeZoneFromUTC", lambda ts, tz: F.from_utc_timestamp(ts, tz).cast("timestamp_ntz"), "ts ; 'Asia/Shanghai'", "T", "ts + INTERVAL 8 HOUR")
add(166, "ConvertTimeZoneToUTC", lambda ts, tz: F.to_utc_timestamp(ts, tz).cast("timestamp_ntz"), "ts ; 'Asia/Shanghai'", "T", "ts - INTERVAL 8 HOUR")
add(167, "ConvertTimeZoneByOffsetFromUTC", lambda ts, n: ts + span(secs=n), "ts ; n", "T", "ts + to_seconds(n)")
add(168, "ConvertTimeZoneByOffsetToUTC", lambda ts, n: ts - span(secs=n), "ts ; n", "T", "ts - to_seconds(n)")
add(169, "toYear", F.year, "ts", "l", "year(ts)")
add(170, "toQuarter", F.quarter, "ts", "l", "quarter(ts)")
add(171, "toMonth", F.month, "ts", "l", "month(ts)")
add(172, "toDayOfMonth", F.dayofmonth, "ts", "l", "day(ts)")
add(173, "toDayOfWeek", lambda ts: F.weekday(ts) + 1, "ts", "l", "isodow(ts)")
add(174, "toDayOfYear", F.dayofyear, "ts", "l", "dayofyear(ts)")
add(175, "toHour", F.hour, "ts", "l", "hour(ts)")
add(176, "toMinute", F.minute, "ts", "l", "minute(ts)")
add(177, "toSecond", F.second, "ts", "l", "second(ts)")
add(178, "toStartOfDay", lambda ts: F.date_trunc("DAY", ts), "ts", "T", "date_trunc('day', ts)")
add(179, "toMonday", lambda ts: F.date_trunc("WEEK", ts).cast("date"), "ts", "D", "date_trunc('week', ts)")
add(180, "toStartOfMonth", lambda ts: F.trunc(ts, "MM"), "ts", "D", "date_trunc('month', ts)")
add(181, "toStartOfQuarter", lambda ts: F.trunc(ts, "QUARTER"), "ts", "D", "date_trunc('quarter', ts)")
add(182, "toStartOfYear", lambda ts: F.trunc(ts, "YEAR"), "ts", "D", "date_trunc('year', ts)")
add(183, "toStartOfMinute", lambda ts: F.date_trunc("MINUTE", ts), "ts", "T", "date_trunc('minute', ts)")
add(184, "toStartOfFiveMinute", floor_to(300), "ts", "T", "time_bucket(INTERVAL 5 MINUTE, ts)")
add(185, "toStartOfFifteenMinutes", floor_to(900), "ts", "T", "time_bucket(INTERVAL 15 MINUTE, ts)")
add(186, "toStartOfHour", lambda ts: F.date_trunc("HOUR", ts), "ts", "T", "date_trunc('hour', ts)")
add(187, "toRelativeYearNum", F.year, "ts", "l", "year(ts)")
add(188, "toRelativeQuarterNum", lambda ts: F.year(ts) * 4 + F.quarter(ts) - 1, "ts", "l", "year(ts) * 4 + quarter(ts) - 1")
add(189, "toRelativeMonthNum", lambda ts: F.year(ts) * 12 + F.month(ts), "ts", "l", "year(ts) * 12 + month(ts)")
add(190, "toRelativeWeekNum", week_number, "d", "l", "(date_diff('day', DATE '1970-01-01', d) + 3) // 7")
add(191, "toRelativeDayNum", F.unix_date, "d", "l", "date_diff('day', DATE '1970-01-01', d)")
add(192, "toRelativeHourNum", lambda ts: F.floor(seconds(ts) / 3600), "ts", "l", "floor(epoch(ts) / 3600)")
add(193, "toRelativeMinuteNum", lambda ts: F.floor(seconds(ts) / 60), "ts", "l", "floor(epoch(ts) / 60)")
add(194, "toRelativeSecondNum", seconds, "ts", "l", "epoch(ts)")
add(195, "toTime", lambda ts: from_seconds(F.pmod(seconds(ts), F.lit(86400))), "ts", "T", "TIMESTAMP '1970-01-01' + (ts - date_trunc('day', ts))")
add(196, "now", clock, "", "D", "CURRENT_DATE", constants=0)
add(197, "today", F.current_date, "", "D", "CURRENT_DATE")
add(198, "yesterday", lambda: F.date_sub(F.current_date(), 1), "", "D", "CURRENT_DATE - 1")
add(199, "timeSlot", floor_to(1800), "ts", "T", "time_bucket(INTERVAL 30 MINUTE, ts)")


def time_slots(ts, duration):
    """Starts of the half hours that a span of seconds from ts touches."""
    return F.transform(F.sequence(F.floor(seconds(ts) / 1800), F.floor((seconds(ts) + duration) / 1800)), lambda n: from_seconds(n * 1800))


add(200, "timeSlots", lambda ts, n: F.array_join(F.transform(time_slots(ts, n), lambda t: F.date_format(t, "HH:mm")), ","), "ts ; n * 100", "s", "array_to_string(list_transform(range(CAST(floor(epoch(ts) / 1800) AS BIGINT), CAST(floor((epoch(ts) + n * 100) / 1800) AS BIGINT) + 1), lambda k: strftime(make_timestamp(k * 1800000000), '%H:%M')), ',')")
add(201, "toYYYYMM", lambda ts: F.year(ts) * 100 + F.month(ts), "ts", "l", "year(ts) * 100 + month(ts)")
add(202, "toYYYYMMDD", lambda ts: F.date_format(ts, "yyyyMMdd").cast("long"), "ts", "l", "strftime(ts, '%Y%m%d')")
add(203, "toYYYYMMDDhhmmss", lambda ts: F.date_format(ts, "yyyyMMddHHmmss").cast("long"), "ts", "l", "strftime(ts, '%Y%m%d%H%M%S')")
add(204, "toDayName", lambda ts: F.date_format(ts, "EEEE"), "ts", "s", "dayname(ts)")
add(205, "toMonthName", lambda ts: F.date_format(ts, "MMMM"), "ts", "s", "monthname(ts)")
for k, (name, move, unit) in enumerate(
    (
        ("Seconds", lambda ts, n: ts + span(secs=n), "seconds"),
        ("Minutes", lambda ts, n: ts + span(minutes=n), "minutes"),
        ("Hours", lambda ts, n: ts + span(hours=n), "hours"),
        ("Days", lambda ts, n: ts + span(days=n), "days"),
        ("Weeks", lambda ts, n: ts + span(days=n * 7), "weeks"),
        ("Months", add_months, "months"),
        ("Years", lambda ts, n: add_months(ts, n * 12), "years"),
    )
):
    add(206 + k, f"add{name}", move, "ts ; j", "T", f"ts + to_{unit}(j)")
    add(213 + k, f"subtract{name}", (lambda f: lambda ts, n: f(ts, -n))(move), "ts ; j", "T", f"ts + to_{unit}(-j)")
add(220, "sysDateWithFsp", clock, "", "D", "CURRENT_DATE", constants=0, given=(3,))
add(221, "sysDateWithoutFsp", lambda: clock(0), "", "D", "CURRENT_DATE")
add(222, "dateDiff", lambda a, b, unit="DAY": diff(unit)(a, b), "ts ; ts2", "l", "date_sub('day', ts, ts2)", constants=2)
add(223, "tidbTimestampDiff", lambda a, b, unit="MONTH": timestamp_diff(unit)(a, b), "ts ; ts2", "l", "(year(ts2) - year(ts)) * 12 + month(ts2) - month(ts) - CASE WHEN ts <= ts2 AND strftime(ts2, '%d%H%M%S%f') < strftime(ts, '%d%H%M%S%f') THEN 1 WHEN ts > ts2 AND strftime(ts2, '%d%H%M%S%f') > strftime(ts, '%d%H%M%S%f') THEN -1 ELSE 0 END", constants=2)
add(224, "extractMyDateTime", lambda ts, unit="DAY_MINUTE": extract(unit)(ts), "ts", "l", "CAST(strftime(ts, '%d%H%M') AS BIGINT)", constants=1)
add(225, "extractMyDateTimeFromString", lambda s, unit="YEAR_MONTH": extract(unit)(s.try_cast("timestamp_ntz")), "st", "l", "CAST(strftime(TRY_CAST(st AS TIMESTAMP), '%Y%m') AS BIGINT)", constants=1)
add(226, "tidbDateDiff", F.date_diff, "d ; d2", "l", "date_diff('day', d2, d)")
add(227, "tidbDayOfWeek", F.dayofweek, "d", "l", "dayofweek(d) + 1")
add(228, "tidbDayOfYear", F.dayofyear, "d", "l", "dayofyear(d)")
add(229, "tidbWeekOfYear", F.weekofyear, "d", "l", "week(d)")
add(230, "tidbToSeconds", lambda ts: seconds(ts) + 719528 * 86400, "ts", "l", "epoch(ts) + 719528::BIGINT * 86400")
add(231, "tidbToDays", lambda d: F.unix_date(d) + 719528, "d", "l", "date_diff('day', DATE '1970-01-01', d) + 719528")
add(232, "tidbFromDays", lambda n: F.date_from_unix_date((n - 719528).cast("int")), "730000 + n", "D", "DATE '1970-01-01' + CAST(730000 + n - 719528 AS INT)")
add(233, "toTimeZone", lambda ts, tz: F.from_utc_timestamp(ts, tz).cast("timestamp_ntz"), "ts ; 'Asia/Tokyo'", "T", "ts + INTERVAL 9 HOUR")
add(234, "toLastDay", F.last_day, "d", "D", "last_day(d)")

add(235, "FunctionConvertDurationFromNanos", lambda n: total_seconds(span(secs=(n / F.lit(1000000000)).cast("decimal(18,6)"))), "id * 1000000000", "d", "id")
add(236, "hour", duration_part(3600, None), "iv", "l", "ivh + 0")
add(237, "minute", duration_part(60, 60), "iv", "l", "ivm")
add(238, "second", duration_part(1, 60), "iv", "l", "ivx")
add(239, "microSecond", lambda iv: (F.abs(total_seconds(iv)) * 1000000 % 1000000).cast("long"), "iv + make_dt_interval(0, 0, 0, CAST(0.25 AS DECIMAL(18,6)))", "l", "250000")
add(240, "tidbTimeToSec", lambda iv: total_seconds(iv).cast("long"), "-iv", "l", "-ivs")


def extract_duration(iv, unit="HOUR_SECOND"):
    parts = {"HOUR": (3600, None), "MINUTE": (60, 60), "SECOND": (1, 60)}
    names = list(parts)
    a, _, b = unit.partition("_")
    out = F.lit(0).cast("long")
    for name in names[names.index(a) : names.index(b or a) + 1]:
        out = out * 100 + duration_part(*parts[name])(iv)
    return out * F.when(total_seconds(iv) < 0, -1).otherwise(1)


add(241, "extractMyDuration", extract_duration, "-iv", "l", "-(ivh * 10000 + ivm * 100 + ivx)", constants=1)
