"""String, language and term functions.

Arguments are term columns (or Python strings for constants).  Functions with a string
result return a term that keeps the language tag of its first argument; tests return a
Spark boolean that is NULL on a type error, so a filter drops the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import (
    BLANK, IRI, LANG_STRING, LITERAL, NUMERIC_TYPES, XSD_STRING, blank_term, iri_term, lang_term,
    literal_term, term,
)


def arg(x) -> Column:
    return literal_term(x) if isinstance(x, str) else x


def is_string(t: Column) -> Column:
    return (t["kind"] == LITERAL) & t["dt"].isin(XSD_STRING, LANG_STRING)


def _like(t: Column, text: Column) -> Column:
    """``text`` with the language tag and datatype of ``t``."""
    return F.when(is_string(t) & text.isNotNull(), term(LITERAL, text, t["lang"], t["dt"]))


def _compatible(a: Column, b: Column) -> Column:
    return is_string(a) & is_string(b) & ((b["lang"] == "") | (a["lang"] == b["lang"]))


# ---------------------------------------------------------------- terms
def str_(t) -> Column:
    t = arg(t)
    return F.when(t["kind"] != BLANK, literal_term(t["value"]))


def text(t) -> Column:
    """The plain Spark string of ``STR(t)``."""
    t = arg(t)
    return F.when(t["kind"] != BLANK, t["value"])


def lang(t) -> Column:
    return F.when(t["kind"] == LITERAL, literal_term(t["lang"]))


def datatype(t) -> Column:
    return F.when(t["kind"] == LITERAL, iri_term(t["dt"]))


def iri(t) -> Column:
    t = arg(t)
    return F.when((t["kind"] == IRI) | (t["dt"] == XSD_STRING), iri_term(t["value"]))


def strdt(t, dt: str) -> Column:
    t = arg(t)
    return F.when(t["dt"] == XSD_STRING, literal_term(t["value"], dt))


def strlang(t, tag: str) -> Column:
    t = arg(t)
    return F.when(t["dt"] == XSD_STRING, lang_term(t["value"], tag))


def bnode(label) -> Column:
    return blank_term(arg(label)["value"])


def is_iri(t: Column) -> Column:
    return t["kind"] == IRI


def is_blank(t: Column) -> Column:
    return t["kind"] == BLANK


def is_literal(t: Column) -> Column:
    return t["kind"] == LITERAL


def is_numeric(t: Column) -> Column:
    from ..terms import NUMBER_TEXT
    return F.when(t.isNotNull(), t["dt"].isin(NUMERIC_TYPES) & t["value"].rlike(NUMBER_TEXT))


def bound(t: Column) -> Column:
    return t.isNotNull()


def same_term(a, b) -> Column:
    return arg(a) == arg(b)


# ---------------------------------------------------------------- strings
def lcase(t) -> Column:
    t = arg(t)
    return _like(t, F.lower(t["value"]))


def ucase(t) -> Column:
    t = arg(t)
    return _like(t, F.upper(t["value"]))


def strlen(t) -> Column:
    t = arg(t)
    return F.when(is_string(t), F.length(t["value"]).cast("long"))


def substr(t, start, length=None) -> Column:
    """Characters from ``start`` (1-based); positions outside the text are cut off."""
    t = arg(t)
    first = F.lit(start) if isinstance(start, int) else start
    begin = F.greatest(first, F.lit(1))
    if length is None:
        size = F.length(t["value"])
    else:
        n = F.lit(length) if isinstance(length, int) else length
        size = F.greatest(first + n - begin, F.lit(0))
    return _like(t, F.substr(t["value"], begin, size))


def concat(*parts) -> Column:
    """The tag survives only when all parts share it."""
    cols = [arg(p) for p in parts]
    ok = reduce(lambda a, b: a & b, [is_string(c) for c in cols])
    same = reduce(lambda a, b: a & b, [c["lang"] == cols[0]["lang"] for c in cols])
    joined = F.concat(*[c["value"] for c in cols])
    tagged = same & (cols[0]["lang"] != "")
    return F.when(ok, term(LITERAL, joined, F.when(tagged, cols[0]["lang"]).otherwise(""),
                           F.when(tagged, LANG_STRING).otherwise(XSD_STRING)))


def contains(a, b) -> Column:
    a, b = arg(a), arg(b)
    return F.when(_compatible(a, b), F.contains(a["value"], b["value"]))


def strstarts(a, b) -> Column:
    a, b = arg(a), arg(b)
    return F.when(_compatible(a, b), F.startswith(a["value"], b["value"]))


def strends(a, b) -> Column:
    a, b = arg(a), arg(b)
    return F.when(_compatible(a, b), F.endswith(a["value"], b["value"]))


def strbefore(a, b) -> Column:
    """Text before the first match; the empty plain string when there is none."""
    a, b = arg(a), arg(b)
    at = F.position(b["value"], a["value"])
    found = _like(a, F.substr(a["value"], F.lit(1), at - 1))
    return F.when(_compatible(a, b), F.when(at == 0, literal_term("")).otherwise(found))


def strafter(a, b) -> Column:
    a, b = arg(a), arg(b)
    at = F.position(b["value"], a["value"])
    found = _like(a, F.substr(a["value"], at + F.length(b["value"])))
    return F.when(_compatible(a, b), F.when(at == 0, literal_term("")).otherwise(found))


def _with_flags(pattern: str, flags: str) -> str:
    if "q" in flags:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    inline = "".join(f for f in "ismx" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


def regex(t, pattern: str, flags: str = "") -> Column:
    t = arg(t)
    return F.when(is_string(t), t["value"].rlike(_with_flags(pattern, flags)))


def replace(t, pattern: str, replacement: str, flags: str = "") -> Column:
    t = arg(t)
    return _like(t, F.regexp_replace(t["value"], _with_flags(pattern, flags), replacement))


def encode_for_uri(t) -> Column:
    t = arg(t)
    coded = F.url_encode(t["value"])
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.when(is_string(t), literal_term(coded))


def lang_matches(tag, language_range: str) -> Column:
    """Basic language range match; ``*`` matches any non-empty tag."""
    tag = F.lower(arg(tag)["value"])
    if language_range == "*":
        return tag != ""
    wanted = language_range.lower()
    return (tag == wanted) | tag.startswith(wanted + "-")


# ---------------------------------------------------------------- published names
def slug(c: Column) -> Column:
    """File- and table-safe name: lower case, other characters to ``_``, ends trimmed."""
    made = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_-]+", "_")
    made = F.regexp_replace(made, "^_+|_+$", "")
    return F.when(made == "", F.lit("query")).otherwise(made)


def normalize_key(c: Column) -> Column:
    """A model key without its ``{n,m}`` tail and one trailing ``+``, ``*`` or ``?``."""
    bare = F.regexp_replace(F.trim(c), r"\{[^}]+\}$", "")
    return F.regexp_replace(bare, r"[+*?]$", "")


def key_values(line: Column) -> Column:
    """``key=value`` words of a line as a map; ``error=`` runs over the following words."""
    words = F.regexp_extract_all(
        line, F.lit(r"(\w+)=((?<=\berror=).*?(?=\s\w+=|$)|\S*)"), F.lit(0))
    pairs = F.transform(words, lambda w: F.struct(
        F.substring_index(w, "=", 1).alias("key"),
        F.substr(w, F.position(F.lit("="), w) + 1).alias("value")))
    last = F.aggregate(
        pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]),
                                  F.create_map(p["key"], p["value"])))
    return last
