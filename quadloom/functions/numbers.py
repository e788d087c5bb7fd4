"""Arithmetic, comparison, date, hash and logic functions over term columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import (
    INTEGER_TYPES, LITERAL, XSD, XSD_BOOLEAN, XSD_DATE, XSD_DATETIME, XSD_DECIMAL, XSD_DOUBLE,
    XSD_FLOAT, XSD_INTEGER, decimal_of, double_of, iri_term, literal_term, number_rank, time_of,
)
from .strings import is_string


#: Exact numbers: sums of two still fit Spark's 38 digits, so no digit is rounded away unseen.
#: A result that does not fit has no value.
EXACT = "decimal(37,18)"


@dataclass(frozen=True)
class Number:
    """A numeric value in the forms an operator may need, each NULL where it does not apply.

    Results of arithmetic carry these along, so a nested expression works on numbers and not
    on the texts of its intermediate terms.
    """

    rank: Column      # 0 integer, 1 decimal, 2 float, 3 double
    whole: Column     # decimal(38,0)
    exact: Column     # EXACT
    floating: Column  # double


def num(x) -> Column:
    """A numeric argument: a term column or a Python number."""
    if isinstance(x, bool):
        raise TypeError("not a number")
    if isinstance(x, int):
        return literal_term(str(x), XSD_INTEGER)
    if isinstance(x, float):
        return literal_term(repr(x), XSD_DOUBLE)
    return x


def _number(x) -> Number:
    if not isinstance(x, Column):
        dt = XSD_INTEGER if isinstance(x, int) else XSD_DOUBLE
        x = num(x)
        return Number(F.lit(0 if dt == XSD_INTEGER else 3), decimal_of(x, "decimal(38,0)"),
                      decimal_of(x, EXACT), double_of(x))
    known = x.__dict__.get("quadloom_number")
    if known is not None:
        return known
    whole = F.when(x["dt"].isin(INTEGER_TYPES), x["value"].try_cast("decimal(38,0)"))
    return Number(number_rank(x), whole, decimal_of(x, EXACT), double_of(x))


def _term(n: Number) -> Column:
    """The literal of a number, unbound where it has no value."""
    exact = F.regexp_replace(
        F.regexp_replace(n.exact.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    floating = F.replace(n.floating.cast("string"), F.lit("Infinity"), F.lit("INF"))
    text = F.when(n.rank == 0, n.whole.cast("string")).when(n.rank == 1, exact).when(n.rank >= 2, floating)
    dt = F.element_at(F.array(*[F.lit(d) for d in (XSD_INTEGER, XSD_DECIMAL, XSD_FLOAT, XSD_DOUBLE)]), n.rank + 1)
    made = F.when(text.isNotNull(), literal_term(text, dt))
    made.__dict__["quadloom_number"] = n
    return made


# ---------------------------------------------------------------- arithmetic
def _higher(a: Column, b: Column) -> Column:
    """The larger rank; NULL unless both are numbers."""
    return F.when(a >= b, a).when(b > a, b)


def _operate(a, b, op, exact=None) -> Column:
    a, b = _number(a), _number(b)
    return _term(Number(_higher(a.rank, b.rank), op(a.whole, b.whole).try_cast("decimal(38,0)"),
                        (exact or op)(a.exact, b.exact).try_cast(EXACT), op(a.floating, b.floating)))


def _split(x: Column) -> tuple[Column, Column]:
    """Whole part and fraction (0 or more) of an exact number."""
    whole = F.floor(x).try_cast("decimal(19,0)")
    return whole, (x - whole).cast("decimal(18,18)")


def _product(a: Column, b: Column) -> Column:
    """The exact product rounded to 18 places, from four products that each keep all digits."""
    (aw, af), (bw, bf) = _split(a), _split(b)
    parts = [F.try_multiply(aw, bw), F.try_multiply(aw, bf), F.try_multiply(af, bw), F.try_multiply(af, bf)]
    out = parts[0].try_cast(EXACT)
    for part in parts[1:]:
        out = F.try_add(out, part.try_cast(EXACT)).try_cast(EXACT)
    return out


def _quotient(a: Column, b: Column) -> Column:
    """Long division by remainders, six places a step; for divisors of more than 13 digits Spark's own
    quotient of six places."""
    out, rest = None, a
    for places in (0, 6, 12, 18):
        over = F.try_mod(rest, b)
        digit = F.try_divide(F.try_subtract(rest, over).try_cast(EXACT), b).try_cast("decimal(19,0)")
        digit = F.try_multiply(digit, F.lit("1" if not places else "0." + "0" * (places - 1) + "1")
                               .cast(f"decimal({max(places, 1)},{places})")).try_cast(EXACT)
        out = digit if out is None else F.try_add(out, digit).try_cast(EXACT)
        rest = F.try_multiply(over.try_cast("decimal(31,18)"), F.lit(10 ** 6).cast("decimal(7,0)")).try_cast(EXACT)
    return F.coalesce(out, F.try_divide(a, b).try_cast(EXACT))


def add(a, b) -> Column:
    return _operate(a, b, F.try_add)


def subtract(a, b) -> Column:
    return _operate(a, b, F.try_subtract)


def multiply(a, b) -> Column:
    return _operate(a, b, F.try_multiply, _product)


def divide(a, b) -> Column:
    """Two integers give a decimal; division of exact numbers by zero is an error."""
    a, b = _number(a), _number(b)
    rank = _higher(a.rank, b.rank)
    x, y = a.floating, b.floating
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(
        x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    floating = F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))
    return _term(Number(F.when(rank == 0, 1).otherwise(rank), F.lit(None).cast("decimal(38,0)"),
                        _quotient(a.exact, b.exact), floating))


def _same_type(t, exact, floating) -> Column:
    n = _number(t)
    return _term(Number(n.rank, n.whole, exact(n.exact).try_cast(EXACT), floating(n.floating)))


def abs_(t) -> Column:
    n = _number(t)
    return _term(Number(n.rank, F.abs(n.whole), F.abs(n.exact), F.abs(n.floating)))


def _whole(d: Column, rounded) -> Column:
    """A double rounded by way of a long; NaN, infinite and large values have no fraction."""
    return F.when(F.abs(d) < 2.0 ** 53, rounded(d).cast("double")).otherwise(d)


def ceil(t) -> Column:
    return _same_type(t, F.ceil, lambda d: _whole(d, F.ceil))


def floor(t) -> Column:
    return _same_type(t, F.floor, lambda d: _whole(d, F.floor))


def round_(t) -> Column:
    """Halves round up, also below zero."""
    return _same_type(t, lambda d: F.floor(d + F.lit("0.5").cast("decimal(2,1)")),
                      lambda d: _whole(d, lambda x: F.floor(x + 0.5)))


def rand() -> Column:
    return literal_term(F.rand().cast("string"), XSD_DOUBLE)


def number(t: Column, kind: str = "long") -> Column:
    """A result cell as a Spark number, NULL when its text is not one."""
    return t["value"].try_cast(kind)


# ---------------------------------------------------------------- comparison
def _is_number(x) -> bool:
    if isinstance(x, Column):
        return "quadloom_number" in x.__dict__
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _compare(a, b, op) -> Column:
    """By value: numbers with numbers, times with times, texts of one language, booleans."""
    out = None
    if not isinstance(a, str) and not isinstance(b, str):
        x, y = _number(a), _number(b)
        out = (
            F.when((x.rank == 0) & (y.rank == 0), op(x.whole, y.whole))
            .when((x.rank <= 1) & (y.rank <= 1), op(x.exact, y.exact))
            .when(x.rank.isNotNull() & y.rank.isNotNull(), op(x.floating, y.floating))
        )
        if _is_number(a) or _is_number(b):
            return out
        out = out.when(a["dt"].isin(XSD_DATETIME, XSD_DATE) & b["dt"].isin(XSD_DATETIME, XSD_DATE),
                       op(time_of(a), time_of(b)))
        out = out.when((a["dt"] == XSD_BOOLEAN) & (b["dt"] == XSD_BOOLEAN),
                       op(a["value"].try_cast("boolean"), b["value"].try_cast("boolean")))
    elif _is_number(a) or _is_number(b):
        return F.lit(None).cast("boolean")
    a, b = _const(a), _const(b)
    texts = is_string(a) & is_string(b) & (a["lang"] == b["lang"])
    found = op(a["value"], b["value"])
    return F.when(texts, found) if out is None else out.when(texts, found)


def _const(x) -> Column:
    if isinstance(x, str):
        return literal_term(x)
    return num(x)


def lt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x < y)


def le(a, b) -> Column:
    return _compare(a, b, lambda x, y: x <= y)


def gt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x > y)


def ge(a, b) -> Column:
    return _compare(a, b, lambda x, y: x >= y)


def eq(a, b) -> Column:
    """Equal by value where both have one; otherwise the same term.

    Two different literals of types without a known value space are an error, not false.
    """
    by_value = _compare(a, b, lambda x, y: x == y)
    a, b = _const(a), _const(b)
    known = [XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"]
    different = (a["kind"] != b["kind"]) | (a["kind"] != LITERAL) | (
        a["dt"].isin(known) & b["dt"].isin(known))
    return F.when(a == b, F.lit(True)).otherwise(
        F.coalesce(by_value, F.when(different, F.lit(False))))


def ne(a, b) -> Column:
    return ~eq(a, b)


def in_(a, items: list) -> Column:
    """Equality with any item: true wins over errors, errors win over false."""
    out = eq(a, items[0]) if items else F.lit(False)
    for item in items[1:]:
        out = out | eq(a, item)
    return out


def not_in(a, items: list) -> Column:
    return ~in_(a, items)


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """An error in the condition is an error of the whole."""
    return F.when(condition.isNotNull(), F.when(condition, yes).otherwise(no))


def coalesce(*terms: Column) -> Column:
    return F.coalesce(*terms)


# ---------------------------------------------------------------- dates
# --- fixed values: lexical form of xsd:dateTime and xsd:date ---
DATETIME_TEXT = (r"^(-?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?))?"
                 r"(Z|[+-]\d{2}:\d{2})?$")
# --- end of fixed values ---


def _field(t: Column, group: int, kind: str) -> Column:
    ok = t["dt"].isin(XSD_DATETIME, XSD + "date") & time_of(t).isNotNull()
    return F.when(ok, F.regexp_extract(t["value"], DATETIME_TEXT, group).try_cast(kind))


def year(t: Column) -> Column:
    return _field(t, 1, "int")


def month(t: Column) -> Column:
    return _field(t, 2, "int")


def day(t: Column) -> Column:
    return _field(t, 3, "int")


def hours(t: Column) -> Column:
    return _field(t, 4, "int")


def minutes(t: Column) -> Column:
    return _field(t, 5, "int")


def seconds(t: Column) -> Column:
    return _field(t, 6, "decimal(18,9)")


def tz(t: Column) -> Column:
    """The zone as written: ``Z``, an offset, or the empty string."""
    return _field(t, 7, "string")


def timezone(t: Column) -> Column:
    """The zone as a day-time duration; unbound when none was written."""
    zone = tz(t)
    sign = F.when(zone.startswith("-"), "-").otherwise("")
    h = F.regexp_extract(zone, r"(\d{2}):(\d{2})", 1).try_cast("int")
    m = F.regexp_extract(zone, r"(\d{2}):(\d{2})", 2).try_cast("int")
    hour = F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise("")
    minute = F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise("")
    made = F.when((zone == "Z") | ((h == 0) & (m == 0)), "PT0S").otherwise(
        F.concat(sign, F.lit("PT"), hour, minute))
    return F.when(zone != "", literal_term(made, XSD + "dayTimeDuration"))


def now() -> Column:
    return literal_term(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), XSD_DATETIME)


# ---------------------------------------------------------------- hashes, identifiers
def _digest(t: Column, made: Column) -> Column:
    return F.when(is_string(t), literal_term(made))


def md5(t: Column) -> Column:
    return _digest(t, F.md5(t["value"]))


def sha1(t: Column) -> Column:
    return _digest(t, F.sha1(t["value"]))


def sha256(t: Column) -> Column:
    return _digest(t, F.sha2(t["value"], 256))


def sha384(t: Column) -> Column:
    return _digest(t, F.sha2(t["value"], 384))


def sha512(t: Column) -> Column:
    return _digest(t, F.sha2(t["value"], 512))


def uuid() -> Column:
    return iri_term(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    return literal_term(F.uuid())

