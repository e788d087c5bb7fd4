"""Function results that the tables do not cover: edge cases of the public SPARQL definitions."""

from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from quadloom import functions as fn
from quadloom.terms import (
    LANG_STRING, XSD, XSD_DATETIME, XSD_DECIMAL, XSD_DOUBLE, XSD_FLOAT, XSD_INTEGER, XSD_STRING, blank_term, iri_term,
    lang_term, literal_term,
)


def lit(v, dt):
    return literal_term(v, XSD + dt)


def cases():
    return {
        # arithmetic and promotion
        "add integers": (fn.add(lit("2", "integer"), lit("3", "int")), ("5", XSD_INTEGER)),
        "integer division": (fn.divide(lit("7", "integer"), lit("2", "integer")), ("3.5", XSD_DECIMAL)),
        "division by zero": (fn.divide(lit("1", "integer"), lit("0", "integer")), None),
        "double division by zero": (fn.divide(lit("1", "double"), 0), ("INF", XSD_DOUBLE)),
        "not a number": (fn.add(literal_term("x"), 1), None),
        "malformed integer": (fn.add(lit("1x", "integer"), 1), None),
        "decimal product": (fn.multiply(lit("1.50", "decimal"), lit("2.25", "decimal")), ("3.375", XSD_DECIMAL)),
        "float and integer": (fn.add(lit("1.5", "float"), 1), ("2.5", XSD_FLOAT)),
        "nested": (fn.add(fn.multiply(lit("2", "integer"), 3), fn.divide(lit("1", "integer"), 4)), ("6.25", XSD_DECIMAL)),
        "round half up": (fn.round_(lit("-2.5", "double")), ("-2.0", XSD_DOUBLE)),
        "round decimal": (fn.round_(lit("2.5", "decimal")), ("3.0", XSD_DECIMAL)),
        "ceil": (fn.ceil(lit("2.1", "decimal")), ("3.0", XSD_DECIMAL)),
        "abs": (fn.abs_(lit("-4", "integer")), ("4", XSD_INTEGER)),
        # strings keep their tag
        "substr tagged": (fn.substr(lang_term("foobar", "en"), 4), ("bar", LANG_STRING)),
        "substr from zero": (fn.substr(literal_term("foobar"), 0, 3), ("fo", XSD_STRING)),
        "strbefore miss": (fn.strbefore(lang_term("abc", "en"), "z"), ("", XSD_STRING)),
        "strbefore empty": (fn.strbefore(lang_term("abc", "en"), ""), ("", LANG_STRING)),
        "strafter empty": (fn.strafter(lang_term("abc", "en"), ""), ("abc", LANG_STRING)),
        "strafter other tag": (fn.strafter(lang_term("abc", "en"), lang_term("b", "fr")), None),
        "concat same tag": (fn.concat(lang_term("a", "en"), lang_term("b", "en")), ("ab", LANG_STRING)),
        "concat mixed": (fn.concat(lang_term("a", "en"), "b"), ("ab", XSD_STRING)),
        "concat number": (fn.concat(literal_term("a"), lit("1", "integer")), None),
        "uri": (fn.encode_for_uri("a b~*ü/+"), ("a%20b~%2A%C3%BC%2F%2B", XSD_STRING)),
        "replace group": (fn.replace(literal_term("abcd"), "b(.)", "[$1]"), ("a[c]d", XSD_STRING)),
        "replace quoted": (fn.replace(literal_term("a.b"), ".", "x", "q"), ("axb", XSD_STRING)),
        "str of blank": (fn.str_(blank_term("b")), None),
        "strlang of tagged": (fn.strlang(lang_term("a", "en"), "fr"), None),
        "timezone": (fn.timezone(literal_term("2011-01-10T14:45:13.815-05:30", XSD_DATETIME)), ("-PT5H30M", XSD + "dayTimeDuration")),
        "no timezone": (fn.timezone(literal_term("2011-01-10T14:45:13", XSD_DATETIME)), None),
    }


def evaluate(spark, made):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(made.values())]).first()
    return dict(zip(made, row))


def test_terms(spark):
    made = cases()
    got = {n: t and (t["value"], t["dt"]) for n, t in evaluate(spark, made).items()}
    assert got == {n: want for n, (_, want) in made.items()}


def truths():
    late = literal_term("2020-01-01T01:00:00+02:00", XSD_DATETIME)
    return {
        "numbers by value": (fn.eq(lit("01", "integer"), lit("1.0", "decimal")), True),
        "numbers order": (fn.lt(lit("9", "integer"), lit("10", "double")), True),
        "number against text": (fn.lt(lit("9", "integer"), literal_term("10")), None),
        "iri and literal differ": (fn.eq(iri_term("a"), literal_term("a")), False),
        "unknown types": (fn.eq(literal_term("a", "x:t"), literal_term("b", "x:t")), None),
        "same unknown term": (fn.eq(literal_term("a", "x:t"), literal_term("a", "x:t")), True),
        "times by value": (fn.lt(late, literal_term("2019-12-31T23:30:00Z", XSD_DATETIME)), True),
        "in wins over error": (fn.in_(lit("2", "integer"), ["x", 2]), True),
        "in with error": (fn.in_(literal_term("a", "x:t"), [literal_term("b", "x:t")]), None),
        "not in": (fn.not_in(lit("2", "integer"), [1, 3]), True),
        "range": (fn.lang_matches(fn.lang(lang_term("x", "en-GB")), "en"), True),
        "range is not a prefix": (fn.lang_matches(fn.lang(lang_term("x", "enx")), "en"), False),
        "any language": (fn.lang_matches(fn.lang(literal_term("x")), "*"), False),
        "numeric": (fn.is_numeric(lit("12x", "integer")), False),
        "contains of number": (fn.contains(lit("12", "integer"), "1"), None),
        "regex dot": (fn.regex(literal_term("a\nb"), "a.b", "s"), True),
        "bound": (fn.bound(F.lit(None)), False),
        "tagged equals": (fn.eq(lang_term("a", "EN"), lang_term("a", "en")), True),
        "boolean order": (fn.lt(lit("false", "boolean"), lit("true", "boolean")), True),
    }


def test_truth(spark):
    made = truths()
    assert evaluate(spark, made) == {n: want for n, (_, want) in made.items()}


def test_dates_and_identifiers(spark):
    t = literal_term("2011-01-10T14:45:13.815-05:00", XSD_DATETIME)
    row = spark.range(1).select(
        fn.year(t), fn.month(t), fn.day(t), fn.hours(t), fn.minutes(t), fn.seconds(t).cast("double"), fn.tz(t),
        fn.year(literal_term("not a date", XSD_DATETIME)), fn.uuid()["value"], fn.struuid()["value"], fn.sha512(literal_term("a"))["value"],
        fn.now()["dt"], fn.rand()["dt"]).first()
    assert tuple(row[:8]) == (2011, 1, 10, 14, 45, 13.815, "-05:00", None)
    assert row[8].startswith("urn:uuid:") and len(row[9]) == 36 and len(row[10]) == 128
    assert tuple(row[11:]) == (XSD_DATETIME, XSD_DOUBLE)


def test_names(spark):
    row = spark.range(1).select(
        fn.slug(F.lit("  My Table! v2 ")), fn.slug(F.lit("***")), fn.slug(F.lit(None).cast("string")), fn.slug(F.lit("a-b_c")),
        fn.normalize_key(F.lit(" ex:knows* ")), fn.normalize_key(F.lit("ex:k{0,2}")), fn.normalize_key(F.lit("x++")),
        fn.key_values(F.lit("service=a event=exit code=1 error=no such file restart_in_ms=1000"))).first()
    assert tuple(row[:7]) == ("my_table_v2", "query", "query", "a-b_c", "ex:knows", "ex:k", "x+")
    assert row[7] == {"service": "a", "event": "exit", "code": "1", "error": "no such file", "restart_in_ms": "1000"}


def test_rounding_beyond_long(spark):
    """Doubles without a fraction stay as they are: large values, NaN and infinity."""
    from quadloom.functions import numbers as N
    from quadloom.terms import XSD_DOUBLE, literal_term

    rows = spark.createDataFrame([("1e300",), ("NaN",), ("-INF",), ("-2.5",)], "x string")
    term = literal_term(F.col("x"), F.lit(XSD_DOUBLE))
    got = rows.select(*[f(term)["value"].cast("double").alias(n) for n, f in (
        ("c", N.ceil), ("f", N.floor), ("r", N.round_))]).collect()
    assert got[0] == (1e300, 1e300, 1e300) and str(got[1].f) == "nan" and got[3] == (-2.0, -3.0, -2.0)


def test_exact_numbers_keep_18_places(spark):
    values = ["1", "-1", "0", "0.00000000014", "0.00000000013", "-0.00000000013", "123456789.123456789123456789", "10", "3",
              "1000000000000", "0.333333333333333333", "999999999999999999", "-7.25"]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    a, b = (literal_term(F.col(c), XSD_DECIMAL) for c in "ab")
    made = rows.select("a", "b", *[f(a, b)["value"].alias(f.__name__) for f in (fn.add, fn.multiply, fn.divide)],
                       fn.lt(a, b).alias("lt"))
    step = Decimal(1).scaleb(-18)
    with localcontext() as context:
        context.prec = 100
        for r in made.collect():
            x, y = Decimal(r.a), Decimal(r.b)
            assert Decimal(r.add) == x + y and r.lt == (x < y)
            if abs(x * y) < 10 ** 19:
                assert abs(Decimal(r.multiply) - x * y) <= 2 * step, r
            else:
                assert r.multiply is None
            if y and abs(y) < 10 ** 13 and abs(x / y) < 10 ** 19:
                assert abs(Decimal(r.divide) - x / y) <= 2 * step, r
            elif not y:
                assert r.divide is None
