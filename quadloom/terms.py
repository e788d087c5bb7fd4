"""RDF terms as Spark structs, and the nodes used to write graph patterns.

A term column is ``struct<kind, value, lang, dt>`` whose fields are never null; an
unbound variable is a NULL struct.  Structs of this shape hash, join and group like any
other Spark value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK, IRI, LITERAL = 0, 1, 2

# --- fixed values (public RDF / XML Schema vocabularies) ---
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
XSD_STRING = XSD + "string"
XSD_BOOLEAN = XSD + "boolean"
XSD_INTEGER = XSD + "integer"
XSD_DECIMAL = XSD + "decimal"
XSD_FLOAT = XSD + "float"
XSD_DOUBLE = XSD + "double"
XSD_DATE = XSD + "date"
XSD_DATETIME = XSD + "dateTime"
INTEGER_TYPES = [
    XSD + name
    for name in (
        "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte",
        "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
        "positiveInteger",
    )
]
NUMERIC_TYPES = INTEGER_TYPES + [XSD_DECIMAL, XSD_FLOAT, XSD_DOUBLE]
# --- end of fixed values ---

TERM = T.StructType([
    T.StructField("kind", T.ByteType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("lang", T.StringType(), False),
    T.StructField("dt", T.StringType(), False),
])

QUADS = T.StructType([
    T.StructField("g", T.StringType(), True),
    T.StructField("s", T.StringType(), False),
    T.StructField("s_kind", T.ByteType(), False),
    T.StructField("p", T.StringType(), False),
    T.StructField("o", TERM, False),
    T.StructField("source_idx", T.IntegerType(), True),
    T.StructField("file_idx", T.IntegerType(), True),
])


# ---------------------------------------------------------------- pattern nodes
@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    dt: str = XSD_STRING
    lang: str = ""


Node = Var | Iri | Lit


# ---------------------------------------------------------------- term columns
def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def term(kind, value, lang="", dt="") -> Column:
    return F.struct(
        _col(kind).cast("byte").alias("kind"),
        _col(value).alias("value"),
        _col(lang).alias("lang"),
        _col(dt).alias("dt"),
    )


def when_bound(value: Column, made: Column) -> Column:
    """``made`` where ``value`` is known, otherwise unbound."""
    return F.when(value.isNotNull(), made)


def iri_term(value) -> Column:
    return term(IRI, value)


def blank_term(value) -> Column:
    return term(BLANK, value)


def literal_term(value, dt=XSD_STRING, lang="") -> Column:
    return term(LITERAL, value, lang, dt)


def lang_term(value, lang) -> Column:
    return term(LITERAL, value, F.lower(_col(lang)), LANG_STRING)


def node_term(node) -> Column:
    """The constant term column of a bound pattern node."""
    if isinstance(node, Iri):
        return iri_term(node.value)
    if isinstance(node, Lit):
        if node.lang:
            return lang_term(node.value, node.lang)
        return literal_term(node.value, node.dt)
    raise TypeError(f"not a constant node: {node!r}")


def subject_term(s="s", s_kind="s_kind") -> Column:
    # the empty fields are written as nullable, like those of stored objects: equal struct
    # types on both sides keep casts out of join keys, so shuffles can be shared
    empty = F.when(F.col(s).isNotNull(), F.lit(""))
    return term(F.col(s_kind), F.col(s), empty, empty)


def value_of(name: str) -> Column:
    """The text of a variable, keeping its name: handy in a final select."""
    return F.col(name)["value"].alias(name)


def values(df: DataFrame, *names: str) -> DataFrame:
    """Plain strings instead of terms for the named (default: all) variables."""
    return df.select(*[value_of(n) for n in (names or df.columns)])


def typed_term(df: DataFrame, name: str) -> Column:
    """Wrap a plain Spark column of ``df`` as a term according to its data type."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StructType):
        return c
    if isinstance(dtype, T.StringType):
        made = literal_term(c)
    elif isinstance(dtype, T.BooleanType):
        made = literal_term(c.cast("string"), XSD_BOOLEAN)
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        made = literal_term(c.cast("string"), XSD_INTEGER)
    elif isinstance(dtype, T.DecimalType):
        text = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
        made = literal_term(F.regexp_replace(text, r"\.$", ".0"), XSD_DECIMAL)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        made = literal_term(c.cast("string"), XSD_DOUBLE)
    elif isinstance(dtype, T.DateType):
        made = literal_term(c.cast("string"), XSD_DATE)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        made = literal_term(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), XSD_DATETIME)
    else:
        raise TypeError(f"no term form for {dtype.simpleString()}")
    return when_bound(c, made)


# ---------------------------------------------------------------- numbers and order
NUMBER_TEXT = r"^\s*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)\s*$"


def double_of(t: Column) -> Column:
    """The double value of a numeric literal, NULL for anything else."""
    ok = t["dt"].isin(NUMERIC_TYPES) & t["value"].rlike(NUMBER_TEXT)
    return F.when(ok, t["value"].try_cast("double"))


def decimal_of(t: Column, kind: str = "decimal(38,18)") -> Column:
    """The exact value of an integer or decimal literal, NULL for anything else."""
    exact = t["dt"].isin(INTEGER_TYPES + [XSD_DECIMAL])
    return F.when(exact, t["value"].try_cast(kind))


def number_rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double: the promotion order of results."""
    return (
        F.when(t["dt"].isin(INTEGER_TYPES), 0)
        .when(t["dt"] == XSD_DECIMAL, 1)
        .when(t["dt"] == XSD_FLOAT, 2)
        .when(t["dt"] == XSD_DOUBLE, 3)
    )


def time_of(t: Column) -> Column:
    return F.when(t["dt"].isin(XSD_DATETIME, XSD_DATE), t["value"].try_cast("timestamp"))


# --- order keys ---
DIGITS, COMPLEMENT = "0123456789", "9876543210"
END, ESCAPED_NUL = "\x00\x01", "\x00\x02"
LOWEST_LONG = -(2 ** 63)


def _text_key(c: Column) -> Column:
    """Text and its end, which sorts before any further character."""
    return F.concat(F.replace(c, F.lit("\x00"), F.lit(ESCAPED_NUL)), F.lit(END))


def _number_key(t: Column) -> Column:
    """Sign, exponent and 17 digits of the double (complemented below zero), then what the double
    cannot tell.

    Numbers of up to 15 characters differ as doubles when they differ at all.  A longer one is placed
    below, at or above its double, with its exact digits.
    """
    def sized(x: Column, shown: Column) -> Column:
        exponent = F.lpad((F.substr(shown, F.lit(20)).try_cast("int") + 400).cast("string"), 3, "0")
        size = F.concat(exponent, F.substr(shown, F.lit(1), F.lit(18)))
        return F.when(x > 0, F.concat(F.lit("3"), size)).otherwise(F.concat(F.lit("1"), F.translate(size, DIGITS, COMPLEMENT)))

    def placed(x: Column) -> Column:
        text = F.array(F.format_string("%.16e", F.abs(x)))
        return (F.when(F.isnan(x), "5").when(x == float("inf"), "4").when(x == float("-inf"), "0").when(x == 0, "2")
                .otherwise(F.transform(text, lambda shown: sized(x, shown))[0]))

    def beyond(row: Column) -> Column:
        text, d = row["text"], row["d"]
        exact, near = (F.when(row["exact"], text.try_cast("decimal(38,18)")), d.try_cast("decimal(38,18)"))
        whole = F.when(row["exact"], text.try_cast("decimal(38,0)"))
        digits = F.coalesce(F.abs(exact).cast("string"), F.abs(whole).cast("string"), F.lit(""))
        digits = F.when(digits != "", F.lpad(digits, 57, "0")).otherwise("")
        place = F.when(exact < near, "0").when(exact > near, "2").otherwise("1")
        signed = F.when(d < 0, F.translate(digits, DIGITS, COMPLEMENT)).otherwise(digits)
        return F.when(F.length(text) <= 15, "1").otherwise(F.concat(place, signed))

    # one row of an array binds its values: a column that is named twice may be computed twice
    row = F.struct(double_of(t).alias("d"), t["dt"].isin(INTEGER_TYPES + [XSD_DECIMAL]).alias("exact"), t["value"].alias("text"))
    return F.transform(F.array(row), lambda r: F.concat(placed(r["d"]), beyond(r)))[0]


def order_key(t: Column) -> Column:
    """A byte string whose order is that of the terms: unbound (NULL) first, then blank nodes, IRIs
    and literals.  Literals: texts and other types by their text, booleans, times by their instant,
    numbers by value; equal values by text, language and type.

    One key serves sorting, range partitioning, MIN and MAX.
    """
    time = time_of(t)
    flag = F.when(t["dt"] == XSD_BOOLEAN, t["value"].try_cast("boolean"))
    instant = F.lpad(F.hex(F.unix_micros(time).bitwiseXOR(F.lit(LOWEST_LONG))), 16, "0")
    by_value = (F.when(t["kind"] != LITERAL, F.lit(""))
                .when(double_of(t).isNotNull(), F.concat(F.lit("3"), _number_key(t)))
                .when(time.isNotNull(), F.concat(F.lit("2"), instant))
                .when(flag.isNotNull(), F.when(flag, "11").otherwise("10")).otherwise("0"))
    # language tags and type names hold no NUL character
    key = F.concat(t["kind"].cast("string"), by_value, _text_key(t["value"]), t["lang"], F.lit(END), t["dt"])
    return F.when(t.isNotNull(), key.cast("binary"))
