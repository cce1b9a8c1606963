"""Casts between types. Results of unsigned types are the next wider signed one; zero dates are NULL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.functions.core import add

INTEGER = "^[+-]?[0-9]+$"
REAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
RANGES = {"UInt8": (0, 255, "short"), "UInt16": (0, 65535, "int"), "UInt32": (0, 2**32 - 1, "long"), "UInt64": (0, 2**64 - 1, "decimal(20,0)")}
RANGES |= {"Int8": (-128, 127, "byte"), "Int16": (-(2**15), 2**15 - 1, "short"), "Int32": (-(2**31), 2**31 - 1, "int"), "Int64": (-(2**63), 2**63 - 1, "long")}


def wrap(name: str):
    """A number cut to an integer and taken into the type's range modulo its size."""
    low, high, kind = RANGES[name]
    size = high - low + 1

    def build(a):
        whole = F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("decimal(38,0)")
        low_, size_ = (F.lit(str(v)).cast("decimal(38,0)") for v in (low, size))
        return (F.pmod(whole - low_, size_) + low_).cast(kind)

    return build


def parse_integer(name: str):
    """A whole string as a number of the type, NULL where it isn't one."""
    low, high, kind = RANGES[name]

    def build(s):
        n = F.when(s.rlike(INTEGER), s).try_cast("decimal(38,0)")
        return F.when(n.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), n).cast(kind)

    return build


def parse_real(kind: str):
    return lambda s: F.when(s.rlike(REAL), s).try_cast(kind)


def parse_date(s):
    return s.try_cast("date")


def parse_datetime(s):
    return s.try_cast("timestamp_ntz")


def best_effort(s):
    """The first layout that fits: ISO date and time, a date, day first, compact digits, seconds since 1970."""
    ladder = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyyMMddHHmmss", "yyyyMMdd")
    tries = [F.try_to_timestamp(s, F.lit(x)).cast("timestamp_ntz") for x in ladder]
    return F.coalesce(*tries, F.timestamp_seconds(F.when(s.rlike("^[0-9]{9,10}$"), s).try_cast("long")).cast("timestamp_ntz"))


def or_zero(build, zero):
    return lambda s: F.coalesce(build(s), zero())


def epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def lenient_int(s):
    """The longest numeric start of a string, 0 where it has none; the fraction rounds half away from zero."""
    head = F.regexp_extract(s, r"^\s*([-+]?[0-9]+)", 1)
    return F.when(s.isNotNull(), F.coalesce(F.when(head != "", head).try_cast("long"), F.lit(0).cast("long")))


#: Letters of the reference's date formats, as Java patterns.
LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a"}


def java_pattern(fmt: str) -> str:
    """A % format as a Java pattern; other letters are quoted."""
    out, text, i = [], "", 0

    def flush():
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in text) else text)
        text = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] in LETTERS:
                flush()
                out.append(LETTERS[fmt[i]])
            else:
                text += fmt[i]
        else:
            text += fmt[i]
        i += 1
    flush()
    return "".join(out)


def date_format(fmt: str):
    return lambda ts: F.date_format(ts, java_pattern(fmt))


def str_to_time(fmt: str, kind: str):
    return lambda s: F.try_to_timestamp(s, F.lit(java_pattern(fmt))).cast(kind)


#: Formats by kind and locale.
FORMATS = {
    "DATE": {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"},
    "DATETIME": {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"},
    "TIME": {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"},
}


def get_format(kind, locale):
    pairs = [F.lit(x) for k, row in FORMATS.items() for loc, f in row.items() for x in (f"{k}:{loc}", f)]
    return F.element_at(F.create_map(*pairs), F.concat(F.upper(kind), F.lit(":"), locale))


def _wrapped(name, x):
    low, high, _ = RANGES[name]
    size = high - low + 1
    v = f"(CAST(trunc({x}) AS HUGEINT) - ({low})::HUGEINT)"
    return f"((({v} % {size}::HUGEINT) + {size}::HUGEINT) % {size}::HUGEINT) + ({low})::HUGEINT"


def _parsed(name, or_else="NULL"):
    low, high, _ = RANGES[name]
    n = f"CASE WHEN regexp_full_match(sn, '[+-]?[0-9]+') THEN TRY_CAST(sn AS HUGEINT) END"
    return f"coalesce(CASE WHEN {n} BETWEEN ({low})::HUGEINT AND ({high})::HUGEINT THEN {n} END, {or_else})"


for k, name in enumerate(("UInt8", "UInt16", "UInt32", "UInt64", "Int8", "Int16", "Int32", "Int64")):
    add(104 + k, f"to{name}", wrap(name), "x * 1000", "s", _wrapped(name, "x * 1000"))
    zero = (lambda kind: lambda: F.lit(0).cast(kind))(RANGES[name][2])
    add(121 + k, f"to{name}OrZero", or_zero(parse_integer(name), zero), "sn", "s", _parsed(name, "0"))
    add(133 + k, f"to{name}OrNull", parse_integer(name), "sn", "s", _parsed(name))

_FLOAT = "CASE WHEN regexp_full_match(sn, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(sn AS {}) END"
add(112, "toFloat32", lambda a: a.cast("float"), "h", "d", "CAST(h AS FLOAT)")
add(113, "toFloat64", lambda a: a.cast("double"), "dc", "d", "CAST(dc AS DOUBLE)")
add(114, "toMyDate", lambda a: a.cast("date"), "ts", "D", "CAST(ts AS DATE)")
add(115, "toDateTime", lambda a: a.cast("timestamp_ntz"), "d", "T", "CAST(d AS TIMESTAMP)")
add(116, "toUUID", lambda s: F.when(s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(s)), "concat('0AB1C2D3-0000-1111-2222-', lpad(cast(id AS string), 12, '0'))", "s", "lower('0AB1C2D3-0000-1111-2222-' || lpad(CAST(id AS VARCHAR), 12, '0'))")
add(117, "toString", lambda a: a.cast("string"), "j", "s", "CAST(j AS VARCHAR)")
add(118, "toFixedString", lambda s, n: F.rpad(s, n, "\0"), "s ; 16", "s", "rpad(s, 16, chr(0))")
add(119, "toUnixTimestamp", lambda a: F.unix_seconds(a.cast("timestamp")), "ts", "l", "epoch(ts)")
add(120, "CAST", lambda a, kind="string": a.cast(kind), "i", "s", "CAST(i AS VARCHAR)", constants=1)
add(129, "toFloat32OrZero", or_zero(parse_real("float"), lambda: F.lit(0.0).cast("float")), "sn", "d", "coalesce(" + _FLOAT.format("FLOAT") + ", 0)")
add(130, "toFloat64OrZero", or_zero(parse_real("double"), lambda: F.lit(0.0)), "sn", "d", "coalesce(" + _FLOAT.format("DOUBLE") + ", 0)")
add(131, "toDateOrZero", or_zero(parse_date, lambda: F.lit("1970-01-01").cast("date")), "sd", "D", "coalesce(TRY_CAST(sd AS DATE), DATE '1970-01-01')")
add(132, "toDateTimeOrZero", or_zero(parse_datetime, epoch), "st", "T", "coalesce(TRY_CAST(st AS TIMESTAMP), TIMESTAMP '1970-01-01')")
add(141, "toFloat32OrNull", parse_real("float"), "sn", "d", _FLOAT.format("FLOAT"))
add(142, "toFloat64OrNull", parse_real("double"), "sn", "d", _FLOAT.format("DOUBLE"))
add(143, "toDateOrNull", parse_date, "sd", "D", "TRY_CAST(sd AS DATE)")
add(144, "toDateTimeOrNull", parse_datetime, "st", "T", "TRY_CAST(st AS TIMESTAMP)")
add(145, "toMyDateOrNull", parse_date, "sd", "D", "TRY_CAST(sd AS DATE)")
add(146, "toMyDateTimeOrNull", parse_datetime, "st", "T", "TRY_CAST(st AS TIMESTAMP)")
_EFFORT = "CASE id % 3 WHEN 0 THEN st WHEN 1 THEN '04/03/2021' ELSE '20210304050607' END"
_EFFORT_SQL = "CASE id % 3 WHEN 0 THEN TRY_CAST(st AS TIMESTAMP) WHEN 1 THEN TIMESTAMP '2021-03-04' ELSE TIMESTAMP '2021-03-04 05:06:07' END"
add(147, "parseDateTimeBestEffort", best_effort, _EFFORT, "T", _EFFORT_SQL)
add(148, "parseDateTimeBestEffortOrZero", or_zero(best_effort, epoch), _EFFORT, "T", f"coalesce({_EFFORT_SQL}, TIMESTAMP '1970-01-01')")
add(149, "parseDateTimeBestEffortOrNull", best_effort, _EFFORT, "T", _EFFORT_SQL)


def _interval(unit):
    zero = lambda: F.lit(0)
    return {
        "second": lambda n: F.make_dt_interval(zero(), zero(), zero(), n),
        "minute": lambda n: F.make_dt_interval(zero(), zero(), n),
        "hour": lambda n: F.make_dt_interval(zero(), n),
        "day": lambda n: F.make_dt_interval(n),
        "week": lambda n: F.make_dt_interval(n * 7),
        "month": lambda n: F.make_ym_interval(zero(), n),
        "year": lambda n: F.make_ym_interval(n),
    }[unit]


# Intervals are held against dates moved by them.
for k, unit in enumerate(("second", "minute", "hour", "day", "week", "month", "year")):
    build = (lambda make: lambda n, ts=None: make(n) if ts is None else ts + make(n))(_interval(unit))
    add(150 + k, f"toInterval{unit.capitalize()}", build, "j ; ts", "T", f"ts + to_{unit}s(CAST(j AS INTEGER))")

add(157, "fromUnixTime", lambda a: F.when(a >= 0, F.timestamp_seconds(a)).cast("timestamp_ntz"), "bi", "T", "CASE WHEN bi >= 0 THEN make_timestamp(bi * 1000000) END")
add(158, "dateFormat", lambda ts, fmt="%Y/%m/%d %H-%i-%s %j": date_format(fmt)(ts), "ts", "s", "strftime(ts, '%Y/%m/%d %H-%M-%S %j')", constants=1)
add(159, "getFormat", get_format, "CASE id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'TIME' ELSE 'DATETIME' END ; CASE id % 2 WHEN 0 THEN 'USA' ELSE 'EUR' END", "s", "CASE id % 6 WHEN 0 THEN '%m.%d.%Y' WHEN 1 THEN '%H.%i.%s' WHEN 2 THEN '%Y-%m-%d %H.%i.%s' WHEN 3 THEN '%d.%m.%Y' WHEN 4 THEN '%h:%i:%s %p' ELSE '%Y-%m-%d %H.%i.%s' END")
add(160, "tidbUnixTimeStampInt", lambda ts: F.unix_seconds(ts.cast("timestamp")), "ts", "l", "epoch(ts)")
add(161, "tidbUnixTimeStampDec", lambda ts: (F.unix_micros(ts.cast("timestamp")) / F.lit(1000000)).cast("decimal(18,6)"), "ts", "d", "epoch(ts)")
add(162, "strToDateDate", lambda s, fmt="%d/%m/%Y": str_to_time(fmt, "date")(s), "date_format(d, 'dd/MM/yyyy')", "D", "d", constants=1)
add(163, "strToDateDatetime", lambda s, fmt="%d/%m/%Y %H:%i:%s": str_to_time(fmt, "timestamp_ntz")(s), "date_format(ts, 'dd/MM/yyyy HH:mm:ss')", "T", "ts", constants=1)
add(164, "tidb_cast", lenient_int, "sn", "l", "CASE WHEN sn IS NOT NULL THEN coalesce(TRY_CAST(nullif(regexp_extract(sn, '^\\s*([-+]?[0-9]+)', 1), '') AS BIGINT), 0) END")
