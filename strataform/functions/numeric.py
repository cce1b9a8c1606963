"""Arithmetic, bits, comparison, logic, conditions, mathematics and rounding."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from strataform.functions.core import add, unsigned


def _any_null(*cs):
    return reduce(lambda a, b: a | b, [c.isNull() for c in cs])


def least(*cs):
    """NULL if any argument is, unlike Spark's own."""
    return F.when(~_any_null(*cs), F.least(*cs))


def greatest(*cs):
    return F.when(~_any_null(*cs), F.greatest(*cs))


def decimal_divide(a, b):
    """NULL by zero. Exact numbers divide exactly, rounded half away from zero at the dividend's scale + 4 (which
    the type of the result may go beyond); where one is a double, both do as doubles."""
    one = F.lit(Decimal(1))  # makes integers decimals, and leaves decimals and doubles what they are
    a, b = a * one, b * one
    q = F.try_divide(a, F.nullif(b, F.lit(0)))
    kind = F.typeof(q)
    scale = F.coalesce(F.regexp_extract(F.typeof(a), r",(\d+)\)", 1).try_cast("int"), F.lit(0))
    return F.when(kind.startswith("decimal"), F.round(q, scale + 4)).otherwise(q)


def _gcd(a, b):
    """In Arrow batches: Euclid's algorithm has no form without a loop, and a fold takes all its steps for each row."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (pc.fill_null(v, 0).to_numpy(zero_copy_only=False) for v in (a, b))
        return pa.array(np.gcd(x, y), mask=pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "long")(a.cast("long"), b.cast("long"))


def _lcm(a, b):
    """In decimals, for it may have 128 bits."""
    a, b = a.cast("long"), b.cast("long")
    wide = lambda v: F.abs(v.cast("decimal(19,0)"))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("decimal(38,0)")).otherwise((F.call_function("div", wide(a), wide(_gcd(a, b))).cast("decimal(19,0)") * wide(b)).cast("decimal(38,0)"))


def int_exp2(a):
    """As an unsigned number; 0 for negative arguments, and no bits are left from 64 on."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.least(a.cast("int"), F.lit(63)), F.lit(0)))
    return F.when(a.isNotNull(), F.when(a.between(0, 63), unsigned(power)).otherwise(F.lit(0).cast("decimal(20,0)")))


def int_exp10(a):
    """0 for negative arguments, and the largest unsigned number above 19."""
    power = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(F.least(a.cast("int"), F.lit(19)), F.lit(0)))).cast("decimal(20,0)")
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    return F.when(a < 0, F.lit(0).cast("decimal(20,0)")).when(a > 19, top).when(a.isNotNull(), power)


def bit_test(a, p):
    """Bits beyond 63 are 0."""
    return F.when(p.between(0, 63), F.getbit(a.cast("long"), F.greatest(F.least(p, F.lit(63)), F.lit(0)))).when(p.isNotNull() & a.isNotNull(), F.lit(0).cast("tinyint"))


def _shift(left: bool):
    def build(a, k):
        """Shifts by 64 or more give 0; the JVM would take them modulo 64."""
        a = a.cast("long")
        moved = F.call_function("shiftleft" if left else "shiftrightunsigned", a, k.cast("int"))
        return unsigned(F.when(k >= 64, F.lit(0).cast("long")).otherwise(moved))

    return build


def _rotate(left: bool):
    def build(a, k):
        a, k = a.cast("long"), F.pmod(k, F.lit(64)).cast("int")
        up, down = (k, F.lit(64) - k) if left else (F.lit(64) - k, k)
        both = F.call_function("shiftleft", a, up).bitwiseOR(F.call_function("shiftrightunsigned", a, down))
        return F.when(k == 0, a).otherwise(both)

    return build


def _mask(*positions):
    return sum(1 << p for p in positions)


def _special(name):
    import math

    f = {"erf": math.erf, "erfc": math.erfc, "lgamma": math.lgamma, "tgamma": math.gamma}[name]

    def safe(v):
        try:
            return f(v)
        except (ValueError, OverflowError):
            return None

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else safe(v))

    return F.pandas_udf(run, "double")


def truth(c):
    return c.cast("boolean")


U64 = "CASE WHEN {0} < 0 THEN CAST({0} AS HUGEINT) + 18446744073709551616 ELSE CAST({0} AS HUGEINT) END"

add(1, "plus", lambda a, b: a + b, "i ; j", "l", "i + j")
add(2, "minus", lambda a, b: a - b, "i ; j", "l", "i - j")
add(3, "multiply", lambda a, b: a * b, "bi ; j", "l", "bi * j")
add(4, "divide", F.try_divide, "x ; y + 0.0037D", "d", "x / (y + 0.0037)")
add(5, "tidbDivide", decimal_divide, "dc ; CAST(j AS DECIMAL(6,2)) / 4", "d", "CASE WHEN j <> 0 THEN sign(dc) * sign(j) * floor(abs(dc) * 4 * 1000000 / abs(j) + 0.5) / 1000000 END")
add(6, "intDiv", lambda a, b: F.call_function("div", a, b), "bi ; nullif(j, 0)", "l", "bi // nullif(j, 0)")
add(7, "intDivOrZero", lambda a, b: F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0)))), "bi ; j", "l", "CASE WHEN j = 0 THEN 0 ELSE bi // nullif(j, 0) END")
add(8, "modulo", F.try_mod, "bi ; j", "l", "CASE WHEN j = 0 THEN NULL ELSE bi % j END")
add(9, "negate", lambda a: -a, "j", "l", "-j")
add(10, "tidbUnaryMinusInt", lambda a: F.try_subtract(F.lit(0).cast("long"), a.cast("long")), "bi", "l", "-bi")
add(11, "tidbUnaryMinusReal", lambda a: -a, "x", "d", "-x")
add(12, "tidbUnaryMinusDecimal", lambda a: -a, "dc", "d", "-dc")
add(13, "abs", F.abs, "j", "l", "abs(j)")
add(14, "bitAnd", lambda a, b: unsigned(a.cast("long").bitwiseAND(b.cast("long"))), "bi ; j", "s", U64.format("(bi & CAST(j AS BIGINT))"))
add(15, "bitOr", lambda a, b: unsigned(a.cast("long").bitwiseOR(b.cast("long"))), "bi ; j", "s", U64.format("(bi | CAST(j AS BIGINT))"))
add(16, "bitXor", lambda a, b: unsigned(a.cast("long").bitwiseXOR(b.cast("long"))), "bi ; j", "s", U64.format("xor(bi, CAST(j AS BIGINT))"))
add(17, "bitNot", lambda a: unsigned(F.bitwise_not(a.cast("long"))), "bi", "s", U64.format("(-bi - 1)"))
add(18, "bitShiftLeft", _shift(True), "id % 1000 ; n", "s", "CASE WHEN n >= 64 THEN 0::HUGEINT ELSE (CAST(id % 1000 AS HUGEINT) * (1::HUGEINT << n)) % 18446744073709551616::HUGEINT END")
add(19, "bitShiftRight", _shift(False), "bi ; n", "s", f"CASE WHEN n >= 64 THEN 0::HUGEINT ELSE ({U64.format('bi')}) // (1::HUGEINT << (n % 64)) END")
add(20, "bitRotateLeft", _rotate(True), "id % 1000 ; n % 50", "l", "CAST(id % 1000 AS BIGINT) * (1::BIGINT << (n % 50))")
add(21, "bitRotateRight", _rotate(False), "(id % 1000) * 1024 ; n % 10", "l", "((id % 1000) * 1024) // (1 << (n % 10))")
add(22, "bitTest", bit_test, "bi ; n", "l", "CASE WHEN n > 63 THEN 0 ELSE ((bi::HUGEINT + 18446744073709551616::HUGEINT) // (1::HUGEINT << (n % 64))) % 2 END")
add(23, "bitTestAny", lambda a, *ps: a.bitwiseAND(reduce(lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))), ps, F.lit(0).cast("long"))) != 0, "bi ; 1 ; 2", "b", f"(bi & {_mask(1, 2)}) <> 0")
add(24, "bitTestAll", lambda a, *ps: (lambda m: a.bitwiseAND(m) == m)(reduce(lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))), ps, F.lit(0).cast("long"))), "bi ; 1 ; 2", "b", f"(bi & {_mask(1, 2)}) = {_mask(1, 2)}")
add(25, "gcd", _gcd, "id ; i", "l", "gcd(id, i)")
add(26, "lcm", _lcm, "bi ; 1000003 + n", "s", "CASE WHEN bi = 0 THEN 0::HUGEINT ELSE abs(bi)::HUGEINT // gcd(bi, 1000003 + n) * (1000003 + n) END")
add(27, "intExp2", int_exp2, "n - 3", "s", "CASE WHEN n < 3 OR n > 66 THEN 0::HUGEINT ELSE 1::HUGEINT << (n - 3) % 64 END")
add(28, "intExp10", int_exp10, "n - 3", "s", "CASE WHEN n < 3 THEN 0::HUGEINT WHEN n > 22 THEN 18446744073709551615::HUGEINT ELSE CAST('1' || repeat('0', n - 3) AS HUGEINT) END")
add(29, "tidbLeast", least, "i ; j", "l", "CASE WHEN j IS NOT NULL THEN least(i, j) END")
add(30, "tidbLeastString", least, "s ; t", "s", "CASE WHEN t IS NOT NULL THEN least(s, t) END")
add(31, "tidbGreatest", greatest, "i ; j", "l", "CASE WHEN j IS NOT NULL THEN greatest(i, j) END")
add(32, "tidbGreatestString", greatest, "s ; t", "s", "CASE WHEN t IS NOT NULL THEN greatest(s, t) END")

add(33, "equals", lambda a, b: a == b, "i ; j", "b", "i = j")
add(34, "notEquals", lambda a, b: a != b, "i ; j", "b", "i <> j")
add(35, "less", lambda a, b: a < b, "i ; j", "b", "i < j")
add(36, "greater", lambda a, b: a > b, "i ; j", "b", "i > j")
add(37, "lessOrEquals", lambda a, b: a <= b, "i ; j", "b", "i <= j")
add(38, "greaterOrEquals", lambda a, b: a >= b, "i ; j", "b", "i >= j")
add(39, "strcmp", lambda a, b: F.when(a < b, -1).when(a == b, 0).when(a > b, 1), "s ; t", "l", "CASE WHEN s < t THEN -1 WHEN s = t THEN 0 WHEN s > t THEN 1 END")
add(40, "isTrue", lambda a: F.coalesce(truth(a), F.lit(False)), "j", "b", "coalesce(j <> 0, false)")
add(41, "isTrueWithNull", truth, "j", "b", "j <> 0")
add(42, "isFalse", lambda a: F.coalesce(~truth(a), F.lit(False)), "j", "b", "coalesce(j = 0, false)")
add(43, "isFalseWithNull", lambda a: ~truth(a), "j", "b", "j = 0")
add(44, "tidbNullEQ", lambda a, b: a.eqNullSafe(b), "nullif(i, 3) ; j", "b", "nullif(i, 3) IS NOT DISTINCT FROM j")
add(45, "and", lambda *cs: reduce(lambda a, b: a & b, map(truth, cs)), "b ; c", "b", "b AND c")
add(46, "two_value_and", lambda *cs: reduce(lambda a, b: a & b, [F.coalesce(truth(c), F.lit(False)) for c in cs]), "b ; c", "b", "coalesce(b, false) AND coalesce(c, false)")
add(47, "or", lambda *cs: reduce(lambda a, b: a | b, map(truth, cs)), "b ; c", "b", "b OR c")
add(48, "xor", lambda a, b: truth(a) != truth(b), "b ; c", "b", "b <> c")
add(49, "not", lambda a: ~truth(a), "b", "b", "NOT b")
add(50, "legacy_and", lambda a, b: truth(a) & truth(b), "j ; c", "b", "j <> 0 AND c")
add(51, "legacy_or", lambda a, b: truth(a) | truth(b), "j ; c", "b", "j <> 0 OR c")
add(52, "legacy_xor", lambda a, b: truth(a) != truth(b), "j ; c", "b", "(j <> 0) <> c")
add(53, "isNull", lambda a: a.isNull(), "j", "b", "j IS NULL")
add(54, "isNotNull", lambda a: a.isNotNull(), "j", "b", "j IS NOT NULL")
add(55, "coalesce", F.coalesce, "j ; i", "l", "coalesce(j, i)")
add(56, "nullIf", F.nullif, "i ; j", "l", "nullif(i, j)")
add(57, "assumeNotNull", lambda a: F.coalesce(a, F.assert_true(F.lit(True)).cast("int"), F.lit(0)), "i", "l", "i")
add(58, "toNullable", lambda a: F.when(F.lit(True), a), "i", "l", "i")
add(59, "if", lambda c, a, b: F.when(truth(c), a).otherwise(b), "b ; i ; j", "l", "CASE WHEN b THEN i ELSE j END")


def multi_if(*cs):
    out = F.when(truth(cs[0]), cs[1])
    for c, v in zip(cs[2::2], cs[3::2], strict=False):
        out = out.when(truth(c), v)
    return out.otherwise(cs[-1]) if len(cs) % 2 else out


add(60, "multiIf", multi_if, "b ; 1 ; c ; 2 ; 3", "l", "CASE WHEN b THEN 1 WHEN c THEN 2 ELSE 3 END")
add(61, "caseWithoutExpr", multi_if, "b ; i ; c ; j", "l", "CASE WHEN b THEN i WHEN c THEN j END")
add(62, "caseWithoutExpression", multi_if, "c ; s ; 'none'", "s", "CASE WHEN c THEN s ELSE 'none' END")


def transform(x, from_, to, default):
    """Maps a value by two arrays; what isn't listed gets the default."""
    return F.coalesce(F.element_at(F.map_from_arrays(from_, to), x), default)


add(63, "transform", transform, "i ; array(1, 2) ; array('a', 'b') ; 'other'", "s", "CASE i WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'other' END")

add(64, "e", F.e, "", "d", "exp(1)")
add(65, "pi", F.pi, "", "d", "pi()")
add(66, "sign", F.signum, "x", "l", "sign(x)")
add(67, "radians", F.radians, "x", "d", "radians(x)")
add(68, "degrees", F.degrees, "h", "d", "degrees(h)")
add(69, "exp", F.exp, "h", "d", "exp(h)")
add(70, "log", F.ln, "x", "d", "CASE WHEN x > 0 THEN ln(x) END")
add(71, "log2args", lambda b, x: F.when((b > 0) & (b != 1) & (x > 0), F.ln(x) / F.ln(b)), "h ; y", "d", "CASE WHEN h > 0 AND h <> 1 AND y > 0 THEN ln(y) / ln(h) END")
add(72, "exp2", lambda a: F.pow(F.lit(2.0), a), "h", "d", "pow(2, h)")
add(73, "log2", F.log2, "x", "d", "CASE WHEN x > 0 THEN log2(x) END")
add(74, "exp10", lambda a: F.pow(F.lit(10.0), a), "z", "d", "pow(10, z)")
add(75, "log10", F.log10, "x", "d", "CASE WHEN x > 0 THEN log10(x) END")
add(76, "sqrt", lambda a: F.when(a >= 0, F.sqrt(a)), "x", "d", "CASE WHEN x >= 0 THEN sqrt(x) END")
add(77, "cbrt", F.cbrt, "x", "d", "cbrt(x)")
add(78, "erf", lambda a: _special("erf")(a), "z", "d", None)
add(79, "erfc", lambda a: _special("erfc")(a), "z", "d", None)
add(80, "lgamma", lambda a: _special("lgamma")(a), "abs(z) + 0.5D", "d", "lgamma(abs(z) + 0.5)")
add(81, "tgamma", lambda a: _special("tgamma")(a), "abs(z) + 0.5D", "d", "gamma(abs(z) + 0.5)")
add(82, "sin", F.sin, "h", "d", "sin(h)")
add(83, "cos", F.cos, "h", "d", "cos(h)")
add(84, "tan", F.tan, "h", "d", "tan(h)")
add(85, "asin", lambda a: F.when(F.abs(a) <= 1, F.asin(a)), "z * 1.5D", "d", "CASE WHEN abs(z * 1.5) <= 1 THEN asin(z * 1.5) END")
add(86, "acos", lambda a: F.when(F.abs(a) <= 1, F.acos(a)), "z * 1.5D", "d", "CASE WHEN abs(z * 1.5) <= 1 THEN acos(z * 1.5) END")
add(87, "atan", F.atan, "h", "d", "atan(h)")
add(88, "pow", F.pow, "abs(z) + 0.5D ; z * 3", "d", "pow(abs(z) + 0.5, z * 3)")
add(89, "roundToExp2", lambda a: F.when(a <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2(a)).cast("int"))), "n", "l", "CASE WHEN n <= 0 THEN 0 ELSE 1 << CAST(floor(log2(n)) AS INT) END")

#: Lower ends of the buckets.
DURATIONS = (1, 10, 30, 60, 120, 180, 240, 300, 600, 1200, 1800, 3600, 7200, 18000, 36000)
AGES = ((1, 0), (18, 17), (25, 18), (35, 25), (45, 35), (55, 45))


def round_duration(a):
    out = F.when(a < DURATIONS[0], 0)
    for low, high in zip(DURATIONS, DURATIONS[1:], strict=False):
        out = out.when(a < high, low)
    return out.otherwise(F.when(a.isNotNull(), DURATIONS[-1]))


def round_age(a):
    out = F.when(a < 1, 0)
    for high, value in AGES[1:]:
        out = out.when(a < high, value)
    return out.otherwise(F.when(a.isNotNull(), 55))


add(90, "roundDuration", round_duration, "id % 40000", "l", "coalesce((SELECT max(v) FROM (VALUES " + ", ".join(f"({v})" for v in DURATIONS) + ") AS b(v) WHERE v <= id % 40000), 0)")
add(91, "roundAge", round_age, "n", "l", "CASE WHEN n < 1 THEN 0 WHEN n < 18 THEN 17 WHEN n < 25 THEN 18 WHEN n < 35 THEN 25 WHEN n < 45 THEN 35 WHEN n < 55 THEN 45 ELSE 55 END")


def trunc(a):
    return F.when(a < 0, F.ceil(a)).otherwise(F.floor(a))


def truncate_frac(a, n: int = 0):
    """Cut to n places, or before the point where n is negative; decimals as decimals."""
    return F.when(a < 0, F.ceil(a, F.lit(n))).otherwise(F.floor(a, F.lit(n)))


add(92, "round", lambda a, n=0: F.round(a, n), "dc", "d", "round(dc, 0)", constants=1)
add(93, "floor", F.floor, "x", "l", "floor(x)")
add(94, "ceil", F.ceil, "x", "l", "ceil(x)")
add(95, "trunc", trunc, "x", "l", "trunc(x)")
add(96, "roundDecimalToInt", lambda a: F.round(a, 0).cast("long"), "dc", "l", "round(dc, 0)")
add(97, "ceilDecimalToInt", lambda a: F.ceil(a).cast("long"), "dc", "l", "ceil(dc)")
add(98, "floorDecimalToInt", lambda a: F.floor(a).cast("long"), "dc", "l", "floor(dc)")
add(99, "truncDecimalToInt", lambda a: trunc(a).cast("long"), "dc", "l", "trunc(CAST(dc AS DOUBLE))")
add(100, "ceiling", F.ceil, "h", "l", "ceil(h)")
add(101, "truncate", trunc, "h", "l", "trunc(h)")
add(102, "tidbRoundWithFrac", lambda a, n=0: F.round(a, n), "dc", "d", "round(dc, 1)", constants=1, given=(1,))
add(103, "tidbTruncateWithFrac", truncate_frac, "CAST(dc AS DECIMAL(30,2)) * 100000000000001 + 0.07", "s", "regexp_replace(CAST(CAST(dc AS DECIMAL(30,2)) * 100000000000001::DECIMAL(15,0) + 0.07 AS VARCHAR), '([.][0-9])[0-9]*$', '\\1')", constants=1, given=(1,))
add(375, "tidbRound", F.rint, "h", "d", "CASE WHEN abs(h) - floor(abs(h)) = 0.5 THEN sign(h) * (floor(abs(h)) + (floor(abs(h)) % 2)) ELSE round(h) END")
