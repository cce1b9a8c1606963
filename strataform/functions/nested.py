"""JSON, geography, tuples, vectors and grouping."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from strataform.functions.core import add

_STEP = re.compile(r'\.\*|\.("(?:[^"\\]|\\.)*"|[A-Za-z_$][\w$]*)|\[\*\]|\[(\d+|last(?:\s*-\s*\d+)?)(?:\s+to\s+(\d+|last(?:\s*-\s*\d+)?))?\]|(\*\*)')


def _index(text: str, size: int) -> int:
    """Of an element, counted from the end after ``last``."""
    return size - 1 - int(text[4:].strip(" -") or 0) if text.startswith("last") else int(text)


def _load(s) -> list:
    """The value alone in a list, or nothing. What is nested deeper than the parser goes is no value."""
    try:
        return [json.loads(s)] if isinstance(s, str) else []
    except (ValueError, RecursionError):
        return []


def _ordered(names) -> list[str]:
    """Keys by length, then by bytes, as the reference stores objects."""
    return sorted(names, key=lambda k: (len(k.encode()), k.encode()))


def dump(v) -> str:
    """Of any depth: what is still to write is on a stack, texts as they are, values in a list of their own."""
    out, todo = [], [[v]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (x,) = x
        parts: list = []
        if isinstance(x, dict):
            for k in _ordered(x):
                parts += [", " if parts else "{", json.dumps(k, ensure_ascii=False) + ": ", [x[k]]]
            parts = [*parts, "}"] if parts else ["{}"]
        elif isinstance(x, list):
            for y in x:
                parts += [", " if parts else "[", [y]]
            parts = [*parts, "]"] if parts else ["[]"]
        else:
            parts = [json.dumps(x, ensure_ascii=False)]
        todo += reversed(parts)
    return "".join(out)


def _inside(v) -> list:
    return list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []


def _below(v):
    """A value and all in it, depth first."""
    todo = [v]
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(_inside(x))


def walk(v, path: str) -> tuple[list, bool]:
    """Values at a path, and whether the path has a wildcard or a range. A scalar is its own element 0."""
    found, wild, at = [v], False, 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"not a JSON path: {path}")
        at = m.end()
        if m[0] == ".*":
            wild, found = True, [y for x in found if isinstance(x, dict) for y in x.values()]
        elif m[0] == "[*]":
            wild, found = True, [y for x in found if isinstance(x, list) for y in x]
        elif m[4]:
            wild, found = True, [y for x in found for y in _below(x)]
        elif m[2]:
            wild |= bool(m[3])
            lists = [x if isinstance(x, list) else [x] for x in found]
            spans = [(_index(m[2], len(x)), _index(m[3] or m[2], len(x))) for x in lists]
            found = [y for x, (i, j) in zip(lists, spans, strict=True) for y in x[max(i, 0) : max(j + 1, 0)] if i >= 0 or m[3]]
        else:
            key = json.loads(m[1]) if m[1][0] == '"' else m[1]
            found = [x[key] for x in found if isinstance(x, dict) and key in x]
    return found, wild


def _over(f, kind: str):
    """A function of a JSON text; NULL for NULL and for what isn't JSON."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(*v) if (v := _load(x)) else None for x in s], dtype=object)

    return lambda c: F.pandas_udf(run, kind)(c)


def json_extract(js, *paths: str):
    """One path without wildcards gives its value, others an array of all they find, nothing gives NULL."""

    def one(v):
        found, wild = [], len(paths) > 1
        for p in paths:
            got, w = walk(v, p)
            found += got
            wild |= w
        return None if not found else dump(found) if wild else dump(found[0])

    return _over(one, "string")(js)


def json_unquote(js):
    return F.when(js.rlike('^".*"$'), F.coalesce(_over(lambda v: v if isinstance(v, str) else dump(v), "string")(js), js)).otherwise(js)


def depth(v) -> int:
    levels, now = 0, [v]
    while now:
        levels, now = levels + 1, [y for x in now for y in _inside(x)]
    return levels


def contains_path(js, how: str, *paths: str):
    check = any if how == "one" else all
    return _over(lambda v: check(bool(walk(v, p)[0]) for p in paths), "boolean")(js)


def keys(js, path: str = "$"):
    def one(v):
        found, _ = walk(v, path)
        return dump(_ordered(found[0])) if found and isinstance(found[0], dict) else None

    return _over(one, "string")(js)


def _json(c):
    """A SQL value as JSON text, whatever its length."""
    text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(6), F.char_length(text) - 6)


def json_array(*cs):
    """From SQL values: strings are JSON strings, NULL is null."""
    return F.concat(F.lit("["), F.concat_ws(", ", *map(_json, cs)), F.lit("]"))


def json_object(*cs):
    """From keys and values in turn, keys by length and bytes; the last of equal keys counts."""
    pairs = [F.concat(_json(k.cast("string")), F.lit(": "), _json(v)) for k, v in zip(cs[::2], cs[1::2], strict=True)]
    return _over(dump, "string")(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))


def scalar_json(c):
    return F.when(c.isNotNull(), _json(c))


def duration_text(iv):
    s = F.abs(iv.cast("interval second").cast("decimal(18,6)"))
    whole = F.floor(s).cast("long")
    text = F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60, ((s - F.floor(s)) * 1000000).cast("long"))
    return F.concat(F.when(iv.cast("interval second").cast("decimal(18,6)") < 0, "-").otherwise(""), text)


add(270, "json_extract", lambda js, *p: json_extract(js, *(p or ("$.a[2].b",))), "js", "s", "CASE WHEN id % 6 = 1 THEN '3' END", "e", constants=1)
add(271, "json_unquote", json_unquote, "js", "s", "CASE WHEN id % 6 = 3 THEN 'text' ELSE js END", "e")
add(272, "cast_json_as_string", _over(dump, "string"), "js", "s", "CASE id % 6 WHEN 2 THEN '[1, \"two\", null]' ELSE js END", "e")
add(273, "jsonLength", _over(lambda v: len(v) if isinstance(v, dict | list) else 1, "long"), "js", "l", "CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 END", "e")
add(274, "json_array", json_array, "k ; et ; CAST(NULL AS INT)", "s", "'[' || k || ', \"' || et || '\", null]'", "e")
add(275, "json_object", json_object, "'kk' ; k ; 'e' ; et", "s", "'{\"e\": \"' || et || '\", \"kk\": ' || k || '}'", "e")
add(276, "cast_json_as_json", lambda js: js, "js", "s", "js", "e")
add(277, "cast_real_as_json", scalar_json, "v", "d", "v", "e")
add(278, "cast_decimal_as_json", lambda d: scalar_json(d.cast("double")), "CAST(v AS DECIMAL(12,2))", "d", "v", "e")
add(279, "cast_int_as_json", scalar_json, "k", "s", "CAST(k AS VARCHAR)", "e")
add(280, "cast_string_as_json", lambda s, parse=False: s if parse else scalar_json(s), "et", "s", "'\"' || et || '\"'", "e", constants=1)
add(281, "cast_time_as_json", lambda ts: F.concat(F.lit('"'), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('"')), "ts", "s", "'\"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '\"'")
add(282, "cast_duration_as_json", lambda iv: F.concat(F.lit('"'), duration_text(iv), F.lit('"')), "iv", "s", "printf('\"%02d:%02d:%02d.000000\"', ivh, ivm, ivx)")
add(283, "json_depth", _over(depth, "long"), "js", "l", "CASE id % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 END", "e")
add(284, "json_contains_path", lambda js, how="one", *p: contains_path(js, how, *(p or ("$.k", "$.kk"))), "js", "b", "CASE WHEN id % 6 < 5 THEN id % 6 < 2 END", "e", constants=1)
add(285, "json_valid_others", lambda c: F.when(c.isNotNull(), F.lit(False)), "k", "b", "false", "e")
add(286, "json_valid_json", lambda c: F.when(c.isNotNull(), F.lit(True)), "js", "b", "CASE WHEN js IS NOT NULL THEN true END", "e")
add(287, "json_valid_string", lambda s: F.when(s.isNotNull(), F.coalesce(_over(lambda v: True, "boolean")(s), F.lit(False))), "jt", "b", "json_valid(jt)", "e")
add(288, "json_keys", keys, "js", "s", "CASE id % 6 WHEN 0 THEN '[\"k\"]' WHEN 1 THEN '[\"a\", \"kk\"]' END", "e")
add(289, "json_keys_2_args", lambda js, path="$.a[2]": keys(js, path), "js", "s", "CASE WHEN id % 6 = 1 THEN '[\"b\"]' END", "e", constants=1)

# --- geography

RADIUS = 6372797.560856  # fixed value: metres


def great_circle(lon1, lat1, lon2, lat2):
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_ellipses(x, y, *ellipses):
    out = F.lit(False)
    for cx, cy, a, b in ellipses:
        out = out | (F.pow((x - cx) / a, 2) + F.pow((y - cy) / b, 2) <= 1)
    return out


def in_polygon(x, y, points):
    """By crossings of a ray to the right; inside where they are odd."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            over = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossed = crossed + F.when(over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


add(313, "greatCircleDistance", great_circle, "h ; z * 50 ; CAST(i AS DOUBLE) ; h", "d", f"2 * {RADIUS} * asin(sqrt(pow(sin(radians(h - z * 50) / 2), 2) + cos(radians(z * 50)) * cos(radians(h)) * pow(sin(radians(i - h) / 2), 2)))")
add(314, "pointInEllipses", lambda x, y, *e: in_ellipses(x, y, *(e or ((0, 0, 2, 3), (5, 5, 1, 1)))), "h ; i", "b", "pow(h / 2, 2) + pow(i / 3.0, 2) <= 1 OR pow(h - 5, 2) + pow(i - 5, 2) <= 1", constants=2)
add(315, "pointInPolygon", lambda x, y, p=((0.25, 0.25), (6.25, 0.25), (0.25, 6.25)): in_polygon(x, y, p), "h ; i", "b", "h > 0.25 AND i > 0.25 AND h + i < 6.5", constants=2)

# --- tuples and vectors


def vec_text(v):
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda e: F.regexp_replace(e.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def _fold(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e)


def _pairs(v, w, f):
    """Over both vectors; lengths that differ are an error."""
    same = F.when(F.size(v) == F.size(w), v).otherwise(F.raise_error(F.lit("vectors have different dimensions")))
    return _fold(F.zip_with(same, w, lambda p, q: f(p.cast("double"), q.cast("double"))))


def dot(v, w):
    return _pairs(v, w, lambda p, q: p * q)


def l2(v, w):
    return F.sqrt(_pairs(v, w, lambda p, q: (p - q) * (p - q)))


def norm(v):
    return F.sqrt(_fold(F.transform(v, lambda e: e.cast("double") * e.cast("double"))))


def cosine(v, w):
    """NULL where a vector has no length."""
    n = norm(v) * norm(w)
    return F.when(n > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(v, w) / n)))


add(316, "tuple", lambda *cs: F.to_json(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(cs, 1)])), "i ; s", "s", "'{\"_1\":' || i || ',\"_2\":\"' || s || '\"}'")
add(317, "tupleElement", lambda t, n=2: t.getField(f"col{n}") if isinstance(n, int) else t.getField(n), "struct(i AS col1, s AS col2)", "s", "s", constants=1)
add(318, "cast_vector_float32_as_string", vec_text, "transform(v, x -> CAST(CAST(x * 8 AS INT) AS FLOAT) / CAST(8 AS FLOAT))", "s", "'[' || array_to_string(list_transform(v, lambda x: regexp_replace(CAST(trunc(x * 8)::INT / 8.0 AS VARCHAR), '\\.?0+$', '')), ',') || ']'", "v")
add(319, "cast_vector_float32_as_vector_float32", lambda v, dims=None: v if dims is None else F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.lit(f"vector doesn't have {dims} dimensions"))), "v", "V", "v", "v", constants=1)
add(320, "vecAsText", vec_text, "array(CAST(1.5 AS FLOAT), CAST(label AS FLOAT))", "s", "'[1.5,' || label || ']'", "v")
add(321, "vecDims", F.size, "v", "l", "len(v)", "v")
add(322, "vecL1Distance", lambda v, w: _pairs(v, w, lambda p, q: F.abs(p - q)), "v ; w", "d", "list_sum(list_transform(range(1, len(v) + 1), lambda k: abs(v[k]::DOUBLE - w[k]::DOUBLE)))", "v")
add(323, "vecL2Distance", l2, "v ; w", "d", "sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda k: pow(v[k]::DOUBLE - w[k]::DOUBLE, 2))))", "v")
add(324, "vecL2Norm", norm, "v", "d", "sqrt(list_sum(list_transform(v, lambda e: e::DOUBLE * e::DOUBLE)))", "v")
add(325, "vecCosineDistance", cosine, "v ; w", "d", "1 - list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k]::DOUBLE * w[k]::DOUBLE)) / (sqrt(list_sum(list_transform(v, lambda e: e::DOUBLE * e::DOUBLE))) * sqrt(list_sum(list_transform(w, lambda e: e::DOUBLE * e::DOUBLE))))", "v")
add(326, "vecNegativeInnerProduct", lambda v, w: -dot(v, w), "v ; w", "d", "-list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k]::DOUBLE * w[k]::DOUBLE))", "v")
