"""Small cases where the engine differs from Spark's defaults."""

import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataform import functions as fn
from strataform.functions import nested, text
from strataform.functions.conversion import java_pattern
from strataform.operators import joins, windows
from strataform.sources import formats, versioned


TS, LATER = datetime.datetime(2021, 3, 4, 5, 6, 7), datetime.datetime(2021, 3, 5, 8, 0, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("tidbDivide", (F.lit, "1.00", 0), None),
        ("modulo", (F.lit, -7, 3), -1),
        ("bitShiftLeft", (F.lit, 1, 64), 0),
        ("bitNot", (F.lit, 0), 2**64 - 1),
        ("tidbLeast", (F.lit, 1, None), None),
        ("intDivOrZero", (F.lit, 5, 0), 0),
        ("tidbRound", (F.lit, -4.5), -4.0),
        ("toUInt8", (F.lit, 257.9), 1),
        ("toInt8", (F.lit, 200), -56),
        ("toInt32OrNull", (F.lit, "12x"), None),
        ("tidb_cast", (F.lit, "2006-01"), 2006),
        ("strcmp", (F.lit, "a", "b"), -1),
        ("tiDBIPv4StringToNum", (F.lit, "1.2.3"), 16908291),
        ("tiDBIPv4StringToNum", (F.lit, "1.2.3.256"), None),
        ("trim", (F.lit, "xyxyaxy", "xy"), "a"),
        ("elt", (F.lit, 0, "a", "b"), None),
        ("replaceOne", (F.lit, "aa", "a", "b"), "ba"),
        ("gcd", (F.lit, 12, -18), 6),
        ("position", (F.lit, "b", "éb"), 3),
        ("formatDecimal", (F.lit, "1.500"), "1.5"),
        ("roundAge", (F.lit, 30), 25),
    ],
)
def test_values(spark, name, args, want):
    _, *values = args
    got = one(spark, fn.get(name)(*values))
    assert got == want


def test_constants_reach_functions(spark):
    cases = [
        ("CAST", ("7.5", "double"), 7.5),
        ("dateFormat", (TS, "%d.%m.%y %H%i"), "04.03.21 0506"),
        ("strToDateDate", ("04-03-2021", "%d-%m-%Y"), datetime.date(2021, 3, 4)),
        ("strToDateDatetime", ("2021/03/04 05", "%Y/%m/%d %H"), datetime.datetime(2021, 3, 4, 5)),
        ("dateDiff", (TS, LATER, "HOUR"), 26),
        ("tidbTimestampDiff", (TS, LATER, "DAY"), 1),
        ("extractMyDateTime", (TS, "HOUR_MINUTE"), 506),
        ("extractMyDateTimeFromString", ("2021-03-04 05:06:07", "DAY_SECOND"), 4050607),
        ("extractMyDuration", (F.expr("INTERVAL '1:02:03' HOUR TO SECOND"), "MINUTE_SECOND"), 203),
        ("cutIPv6", (F.unhex(F.lit("20010DB8000000000000000000000001")), 15, 0), "2000::"),
        ("conv", ("777", 8, 16), "1FF"),
        ("json_extract", ('{"a": [1, 2, 3]}', "$.a[1]"), "2"),
        ("json_extract", ('{"a": [1, 2, 3]}', "$.a[last]"), "3"),
        ("json_extract", ('{"a": [1, 2, 3]}', "$.a[0 to 1]"), "[1, 2]"),
        ("json_extract", ('{"a": [1, 2, 3]}', "$.a[last-1 to last]"), "[2, 3]"),
        ("json_extract", ('[1, 2, {"a": "b"}]', "$[0]", "$[1]", "$[2].a"), '[1, 2, "b"]'),
        ("json_extract", ("[1]", "$[3]"), None),
        ("json_contains_path", ('{"a": 1}', "all", "$.a", "$.b"), False),
        ("json_keys_2_args", ('{"a": {"c": 1, "bb": 2, "b": 3}}', "$.a"), '["b", "c", "bb"]'),
        ("cast_string_as_json", ("[1]", True), "[1]"),
        ("regexp", ("abc", "b.$"), True),
        ("regexp_like", ("aBb", "bb", "i"), True),
        ("regexp_like", ("ab\nabc", "^abc$", "m"), True),
        ("regexp_instr", ("ab\nabc", "^abc$", 1, 1, 0, "m"), 4),
        ("regexp_instr", ("abcabc", "c", 1, 2, 1), 7),
        ("regexp_instr", ("\x01a\x02b", "b"), 4),
        ("regexp_substr", ("123 456", "[0-9]+", 1, 2), "456"),
        ("regexp_substr", ("abc", "x"), None),
        ("regexp_replace", ("a-b-c", "-", "\\0+", 1, 2), "a-b-+c"),
        ("regexp_replace", ("aa", "a", "$1"), "$1$1"),
        ("regexp_replace", ("abab", "(a)(b)", "\\2\\1", 1, 2), "abba"),
        ("regexp_replace", ("abc", "x", "y", 1, 1), "abc"),
        ("replaceRegexpOne", ("abcb", "b", "<\\0>"), "a<b>cb"),
        ("replaceRegexpAll", ("abcb", "b", "$"), "a$c$"),
        ("like", ("a_c", "a\\_%"), True),
        ("notLike", ("abc", "x%"), True),
        ("like3Args", ("50%", "50!%", "!"), True),
        ("ilike3Args", ("ABC", "a%", "!"), True),
        ("match", ("abc", "^b"), False),
        ("extract", ("k=v", "(.)=(.)", 2), "v"),
        ("extractURLParameter", ("http://x/?a.b=1&b=2", "b"), "2"),
        ("cutURLParameter", ("http://x/?a=1&b=2", "a"), "http://x/?b=2"),
        ("date_add", (TS, 2, "HOUR"), datetime.datetime(2021, 3, 4, 7, 6, 7)),
        ("date_sub", (TS, 1, "DAY"), datetime.datetime(2021, 3, 3, 5, 6, 7)),
        ("tupleElement", (F.struct(F.lit(1).alias("col1"), F.lit("b").alias("col2")), 1), 1),
        ("tupleElement", (F.struct(F.lit("n").alias("name")), "name"), "n"),
        ("format", (1234.567, 1), "1,234.6"),
        ("formatWithLocale", (1234.567, 1, "de_DE"), "1.234,6"),
        ("pointInEllipses", (0.0, 2.0, (0, 0, 1, 3)), True),
        ("pointInPolygon", (2.0, 2.0, ((0, 0), (4, 0), (0, 5))), True),
        ("toInterval" + "Hour", (2, TS), datetime.datetime(2021, 3, 4, 7, 6, 7)),
        ("tidbDivide", (F.lit("1").cast("decimal(4,0)"), F.lit("20001").cast("decimal(38,20)")), Decimal(0)),
        ("tidbDivide", (F.lit("1").cast("decimal(4,0)"), F.lit("20000").cast("decimal(38,20)")), Decimal("0.0001")),
        ("tidbDivide", (1, Decimal("0.5")), Decimal(2)),
        ("tidbDivide", (1, Decimal("2.4")), Decimal("0.4167")),
        ("tidbDivide", (Decimal("1.23456"), 1), Decimal("1.23456")),
        ("tidbDivide", (-1, 3), Decimal("-0.3333")),
        ("tidbDivide", (1.0, 3), 1 / 3),
        ("tidbDivide", (1, 0), None),
        ("intExp2", (63,), Decimal(2**63)),
        ("intExp2", (64,), Decimal(0)),
        ("intExp10", (19,), Decimal(10**19)),
        ("intExp10", (20,), Decimal(2**64 - 1)),
        ("intExp10", (-1,), Decimal(0)),
        ("lcm", (9007199254740993, 3), Decimal(9007199254740993)),
        ("lcm", (2**62 + 1, 2**62 - 1), Decimal((2**62 + 1) * (2**62 - 1))),
        ("gcd", (None, 3), None),
        ("bitTest", (-1, 70), 0),
        ("bitTest", (-1, 63), 1),
        ("tidbTruncateWithFrac", (F.lit("12345678901234567.89").cast("decimal(20,2)"), 1), Decimal("12345678901234567.8")),
        ("tidbTruncateWithFrac", (F.lit("-129.99").cast("decimal(20,2)"), -1), Decimal(-120)),
        ("tidbRoundWithFrac", (F.lit("2.45").cast("decimal(5,2)"), 1), Decimal("2.5")),
    ]
    wrong = []
    for name, args, want in cases:
        got = one(spark, fn.get(name)(*args))
        if got != (pytest.approx(want) if isinstance(want, float) else want):
            wrong.append((name, args[1:], want, got))
    assert not wrong
    tested = {name for name, args, _ in cases if fn.get(name).constants is not None and len(args) > fn.get(name).constants}
    assert {f.name for f in fn.CATALOGUE.values() if f.constants} - tested <= {"round", "cast_vector_float32_as_vector_float32"}


def test_every_function_with_constants_refuses_columns_there():
    for f in fn.CATALOGUE.values():
        if f.constants is not None:
            with pytest.raises(TypeError):
                f(*[F.lit(1)] * (f.constants + 1))


def test_patterns_may_be_columns(spark):
    rows = spark.createDataFrame([("abc", "b", "a%"), ("abc", "x", "b%")], "s string, p string, l string")
    got = rows.select(fn.get("regexp")("abc", F.col("p")).alias("r"), fn.get("like")(F.col("s"), F.col("l")).alias("l"), fn.get("match")(F.col("s"), F.col("p")).alias("m")).collect()
    assert [tuple(x) for x in got] == [(True, True, True), (False, False, False)]


def test_clocks(spark):
    rows = spark.range(1).select(*[fn.get("now")(k).alias(f"n{k}") for k in (0, 3, 6)], fn.get("sysDateWithoutFsp")().alias("s"), F.current_timestamp().cast("timestamp_ntz").alias("t")).first()
    assert rows.n0 == rows.s == rows.t.replace(microsecond=0) and rows.n6 == rows.t
    assert rows.n3 == rows.t.replace(microsecond=rows.t.microsecond // 1000 * 1000)


def test_long_and_deep_json(spark):
    long = "x" * 1_200_002
    assert one(spark, F.char_length(fn.get("cast_string_as_json")(long))) == len(long) + 2
    assert one(spark, F.char_length(fn.get("json_object")(long, 1))) == len(long) + 7
    deep = "[" * 900 + "]" * 900
    assert one(spark, fn.get("json_depth")(deep)) == 900 and one(spark, fn.get("cast_json_as_string")(deep)) == deep
    far = "[" * 200_000 + "]" * 200_000
    assert one(spark, fn.get("json_depth")(far)) in (None, 200_000)
    assert one(spark, fn.get("json_object")("a", None, "a", "é\n")) == '{"a": "é\\n"}'


def test_json_paths(spark):
    js = F.lit('{"a": [1, {"b": 2}], "long": true, "c": null}')
    assert one(spark, nested.json_extract(js, "$.a[1].b")) == "2"
    assert one(spark, nested.json_extract(js, "$.a[*]")) == '[1, {"b": 2}]'
    assert one(spark, nested.json_extract(js, "$.a[0]", "$.long")) == "[1, true]"
    assert one(spark, nested.json_extract(js, "$**.b")) == "[2]"
    assert one(spark, nested.json_extract(js, "$.none")) is None
    assert one(spark, nested.contains_path(js, "all", "$.a", "$.c")) is True
    assert one(spark, nested.keys(js)) == '["a", "c", "long"]'
    assert one(spark, nested.json_object(F.lit("bb"), F.lit(1), F.lit("a"), F.lit("x"))) == '{"a": "x", "bb": 1}'


def test_regexp_arguments(spark):
    s = F.lit("abc ABC abd")
    assert one(spark, text.regexp_like(s, "ABD", "i")) is True
    assert one(spark, text.regexp_substr(s, "ab.", 1, 2)) == "abd"
    assert one(spark, text.regexp_instr(s, "ab.", 1, 2)) == 9
    assert one(spark, text.regexp_instr(s, "ab.", 1, 1, 1)) == 4
    assert one(spark, text.regexp_instr(s, "x", 1)) == 0
    assert one(spark, text.regexp_replace(s, "ab(.)", r"<\1>", 1, 2)) == "abc ABC <d>"
    assert one(spark, text.regexp_replace(s, "b", "X", 4)) == "abc ABC aXd"


def test_date_formats():
    assert java_pattern("%Y-%m-%d %H:%i:%s") == "yyyy-MM-dd HH:mm:ss"
    assert java_pattern("day %d") == "'day 'dd"


def test_polygon(spark):
    square = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))
    inside = [one(spark, nested.in_polygon(F.lit(x), F.lit(y), square)) for x, y in ((1.0, 1.0), (5.0, 1.0), (-1.0, 2.0), (3.9, 3.9))]
    assert inside == [True, False, False, True]


def test_three_valued_in(spark):
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    value = lambda right, anti=False: {x.k: x.matched for x in joins.in_value(left, spark.createDataFrame(right, "r int"), "k", "r", anti=anti).collect()}
    assert value([(1,), (None,)]) == {1: True, 3: None, None: None}
    assert value([(1,)]) == {1: True, 3: False, None: None}
    assert value([]) == {1: False, 3: False, None: False}
    assert value([(1,), (None,)], True) == {1: False, 3: None, None: None}
    assert joins.not_in(left, spark.createDataFrame([(1,)], "r int"), "k", "r").collect() == [(3,)]


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, None, 3, True), (3, "d", 2, False)], "h int, v string, _version long, _deleted boolean")
    assert sorted(versioned.snapshot(rows, "h").collect()) == [(1, "b"), (3, "d")]
    assert sorted(versioned.snapshot(rows, "h", at=1).collect()) == [(1, "a"), (2, "c")]
    assert versioned.fast(rows).count() == 4
    versioned.compact(rows, "h", str(tmp_path / "t"), 2)
    assert sorted(versioned.snapshot(spark.read.parquet(str(tmp_path / "t")), "h").collect()) == [(1, "b"), (3, "d")]


@pytest.mark.parametrize("name", [x for x in formats.FORMATS if x != "Null"])
def test_formats_keep_odd_values(spark, tmp_path, name):
    rows = spark.createDataFrame([(1, "a b", 1.5), (2, None, None), (3, 'q"uote', -0.0), (4, "", 2.0), (5, "t\tn\n\\\\N \\", 0.5), (6, " lead", 1e300)], "k int, s string, x double")
    formats.write(rows, str(tmp_path / name), name)
    assert sorted(formats.read(spark, str(tmp_path / name), name, rows.schema).collect()) == sorted(rows.collect())


def test_variable_lag(spark):
    rows = spark.createDataFrame([("a", i, i % 3 - 1) for i in range(6)], "g string, o int, n int")
    got = windows.shifted(rows, ["g"], ["o"], "o", F.col("n"), F.lit(-9), "v", lead=False)
    assert {x.o: x.v for x in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_top_n_and_scans_are_planned_well(spark):
    from strataform.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("o099_top_n")
    scan = plan("o041_filter_pushdown")
    assert "PushedFilters: [IsNotNull(o_orderdate)" in scan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate" in scan


def test_sequences_with_guards():
    from strataform.operators.aggregates import match_sequences, parse_sequence

    match = lambda pattern, times, flags, count=False: match_sequences(parse_sequence(pattern), times, flags, count)
    assert match("(?1)(?t<=5)(?2)", [0, 4], [1, 2]) == 1 and match("(?1)(?t<=5)(?2)", [0, 6], [1, 2]) == 0
    assert match("(?1).*(?t<=5)(?2)", [0, 2, 9, 12], [1, 0, 1, 2]) == 1 and match("(?1).*(?t>5)(?2)", [0, 2, 3], [1, 0, 2]) == 0
    assert match("(?1).(?2)", [0, 1, 2], [1, 1, 2]) == 1 and match("(?1)(?2)", [0, 1], [3, 3]) == 1
    assert match("(?1)(?2)", [0, 1, 2, 3, 4], [1, 2, 1, 1, 2], True) == 2 and match("(?1)", [], []) == 0
    with pytest.raises(ValueError):
        parse_sequence("(?1)x")


def test_sums_of_a_hot_key(spark):
    from strataform.operators.aggregates import compensated_sum, wrapping_sum

    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, 'k') AS g", "id AS o", "id % 7 AS v").repartition(6)
    got = windows.running_sums(rows, ["g"], [F.asc("o")], {"s": F.col("v"), "n": F.lit(1)}).collect()
    for g in (None, "k"):
        total = 0
        for k, x in enumerate(sorted((x for x in got if x.g == g), key=lambda x: x.o)):
            total += x.v
            assert (x.s, x.n) == (total, k + 1)
    big = spark.createDataFrame([(2**62,), (2**62,), (5,)], "x long")
    assert big.agg(wrapping_sum(F.col("x")).alias("v")).first().v == -(2**63) + 5
    some = spark.createDataFrame([(1e16,), (1.0,), (-1e16,)], "x double").coalesce(1)
    assert some.agg(compensated_sum(F.col("x")).alias("v")).first().v == 1.0


def test_products_go_round(spark):
    from strataform.operators.aggregates import CATALOGUE, wrapping_product

    rows = spark.createDataFrame([(150_000, 1000), (-(2**63), 2**63 - 1), (-(2**63), -(2**63)), (3, None)], "o long, n long")
    round_ = lambda v: (v + 2**63) % 2**64 - 2**63
    want = [None if n is None else round_(o * 1000003 * n * 1000003) for o, n in rows.collect()]
    assert [x.v for x in rows.select(wrapping_product(F.col("o"), F.lit(1000003), F.col("n"), F.lit(1000003)).alias("v")).collect()] == want
    assert CATALOGUE["sumWithOverflow"].run(rows.selectExpr("'a' AS g", "o", "n")).first().v == round_(sum(v for v in want if v is not None))


def test_arguments_of_extremes_are_by_the_whole_key(spark):
    from strataform.operators.aggregates import CATALOGUE

    rows = spark.createDataFrame([("1.00", 30_000), ("1.01", 7), ("9.00", 7), ("8.99", 30_000)], "dc string, o long").selectExpr("'a' AS g", "CAST(dc AS DECIMAL(15,2)) AS dc", "o", "1 AS i")
    assert (CATALOGUE["argMin"].run(rows).first().v, CATALOGUE["argMax"].run(rows).first().v) == (7, 30_000)


def test_years_of_five_digits_have_no_sign(spark):
    from strataform.functions.core import KINDS

    assert one(spark, KINDS["T"][1](fn.get("fromUnixTime")(258402 * 1000003 - 5000000000))) == "10000-01-06 11:46:46"


@pytest.mark.parametrize(("name", "last"), [("IPv4NumToString", "160"), ("IPv4NumToStringClassC", "xxx")])
def test_numbers_beyond_addresses_keep_their_first_part(spark, name, last):
    assert one(spark, fn.get(name)(100000 * 70001)) == f"417.61.12.{last}" and one(spark, fn.get(name)(F.lit(2**32 - 1).cast("long"))) == f"255.255.255.{last.replace('160', '255')}"


def test_rounding_is_that_of_sql(spark):
    import duckdb

    from strataform.functions.core import KINDS

    values = [-3e-7, -0.0, 0.0, 5e-7, -5e-7, 213055788.13078249, -0.0078125, 1e300, -1e308, float("inf"), None]
    want = [None if v is None else repr(v) for (v,) in duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    text_of = lambda v: None if v is None else repr(v)
    assert [text_of(x.d) for x in rows.select(KINDS["d"][1](F.col("v")).alias("d")).collect()] == want
    assert [text_of(v) for v in one(spark, KINDS["V"][1](F.array(*[F.lit(v).cast("double") for v in values])))] == want


@pytest.mark.parametrize("name", ["uniq", "uniqHLL12", "uniqCombined", "State"])
def test_sketches_are_one_for_a_group(spark, name):
    from strataform.operators.aggregates import CATALOGUE

    rows = spark.range(4000).selectExpr("IF(id % 4 = 0, 'a', 'b') AS g", "IF(id % 5 = 0, NULL, id % 700) AS k")
    got = CATALOGUE[name].run(rows.unionByName(spark.createDataFrame([("c", None)], "g string, k long")).where("g < 'c'" if name == "State" else "true"))
    want = {g: len({i % 700 for i in range(4000) if i % 5 and (i % 4 == 0) == (g == "a")}) for g in "ab"} | ({} if name == "State" else {"c": 0})
    assert {x.g: x.exact for x in got.collect()} == want and all(x.within for x in got.collect())
    by_value = [x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if re.search(r"keys=\[g#\d+, k#", x)]
    assert by_value and all("functions=[]" in x for x in by_value)  # no sketch for each value


def test_gathered_joins_are_inner_joins(spark, monkeypatch):
    monkeypatch.setattr(joins, "GATHERED", 16)
    left = spark.createDataFrame([(i, None if i % 10 == 0 else f"k{i % 3}") for i in range(100)], "a int, k string")
    right = spark.createDataFrame([(None if i % 50 == 7 else i, f"k{i % 4}") for i in range(200)] + [(7, None), (9, "k1"), (9, "k1")], "b int, k string")
    got = joins.gathered(left, right, "k", "b")
    assert sorted(map(tuple, got.select("a", "k", "b").collect()), key=str) == sorted(map(tuple, left.join(right, "k").select("a", "k", "b").collect()), key=str)
    assert joins.gathered(left, right.where("false"), "k", "b").count() == 0


def test_decimal_key_join_deals_its_pairs(spark):
    from strataform.plans.catalogue import QUERIES

    plan = QUERIES["o064_decimal_key_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "REPARTITION_BY_NUM" in plan
