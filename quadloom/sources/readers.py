"""Text files of triples and quads to the quad table, parsed by Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import LOOKUP_ROWS, lookup
from ..terms import BLANK, IRI, LANG_STRING, LITERAL, XSD_STRING, term
from . import workers
from .catalog import _bare
from .identity import spread
from .turtle import parse_turtle

# --- fixed values: terms of the line formats (public N-Triples / N-Quads grammar) ---
IRI_TEXT = r"<([^\x00-\x20<>\"{}|^`]++)>"
BLANK_TEXT = r"_:([\p{L}\p{N}_:](?:[\p{L}\p{N}_:.\-\u00B7]*[\p{L}\p{N}_:\-\u00B7])?)"
LITERAL_TEXT = (r'"([^"\\]*+(?:\\(?:[tbnrf"' r"'" r'\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})[^"\\]*+)*+)"'
                r"(?:@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^" + IRI_TEXT + ")?")
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
# --- end of fixed values ---

_TRIPLE = rf"^\s*(?:{IRI_TEXT}|{BLANK_TEXT})\s*{IRI_TEXT}\s*(?:{IRI_TEXT}|{BLANK_TEXT}|{LITERAL_TEXT})\s*"
_END = r"\.\s*(?:#.*)?$"
NTRIPLES_LINE = _TRIPLE + _END
NQUADS_LINE = _TRIPLE + rf"(?:(?:{IRI_TEXT}|{BLANK_TEXT})\s*)?" + _END

PARSED = "source_idx int, file_idx int, line string"


# ---------------------------------------------------------------- lines
def read_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(source_idx, file_idx, line)`` of plain and compressed files.

    Spark's text source reads and splits everything but xz.  The file positions come from
    a lookup on the file name Spark gives with each row; very many files are taken in
    several bounded lookups.
    """
    parts, batch = [], []

    def flush():
        plain: dict[str, list] = {}  # a file may stand under several sources
        for *place, path in batch:
            if not path.endswith(".xz"):
                plain.setdefault(path, []).append(place)
        packed = [r for r in batch if r[2].endswith(".xz")]
        if plain:
            paths = list(plain)
            # the reader's own spelling of each path, from file metadata only
            listed = spark.read.format("binaryFile").load(paths).select(
                _bare(F.col("path")).alias("path"), F.col("_metadata.file_path").alias("uri"))
            rows = [(*place, r["uri"]) for r in listed.toLocalIterator() for place in plain[r["path"]]]
            table = lookup(spark, rows, "source_idx int, file_idx int, __uri string")
            text = spark.read.text(paths).select(
                F.col("value").alias("line"), F.col("_metadata.file_path").alias("__uri"))
            parts.append(text.join(table, "__uri").select("source_idx", "file_idx", "line"))
        if packed:
            rows = spark.createDataFrame(packed, "source_idx int, file_idx int, path string")
            parts.append(spread(rows).mapInPandas(workers.xz_lines, PARSED))

    for row in files.select("source_idx", "file_idx", "path").toLocalIterator():
        batch.append(tuple(row))
        if len(batch) == LOOKUP_ROWS:
            flush()
            batch = []
    if batch:
        flush()
    if not parts:
        return spark.createDataFrame([], PARSED)
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- escapes
def unescape(c: Column) -> Column:
    """Text with its escapes resolved; values without a backslash are passed through."""
    simple = c
    for code in "tbnrf\"'":
        simple = F.replace(simple, F.lit("\\" + code), F.lit(ESCAPES[code]))
    pieces = F.regexp_extract_all(
        c, F.lit(r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]++"), F.lit(0))

    def piece(x: Column) -> Column:
        code = F.substr(x, F.lit(3))
        out = F.when(x.startswith("\\u") | x.startswith("\\U"),
                     F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        for key, char in ESCAPES.items():
            out = out.when(x == "\\" + key, F.lit(char))
        return out.otherwise(x)

    full = F.array_join(F.transform(pieces, piece), "")
    hard = F.contains(c, F.lit("\\\\")) | F.contains(c, F.lit("\\u")) | F.contains(c, F.lit("\\U"))
    return F.when(~F.contains(c, F.lit("\\")), c).when(hard, full).otherwise(simple)


def escape(c: Column) -> Column:
    """Text with backslash, quote and control characters escaped for the line formats."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code in 'tbnrf"':
        out = F.replace(out, F.lit(ESCAPES[code]), F.lit("\\" + code))
    return out


# ---------------------------------------------------------------- line formats
def _scoped(label: Column) -> Column:
    """Blank node labels belong to their file."""
    return F.concat_ws("/", "scope", label)


def _parsed(lines: DataFrame, line_regex: str, fields: int) -> DataFrame:
    """One match per line: the groups joined by a line feed, which no line can contain."""
    start = F.ltrim("line", F.lit(" \t\r"))
    kept = lines.filter((start != "") & ~start.startswith("#"))
    if "scope" not in lines.columns:
        kept = kept.withColumn("scope", F.concat_ws("/", "source_idx", "file_idx"))
    template = "\n".join(f"${i}" for i in range(1, fields + 1))
    parts = F.split(F.regexp_replace("line", line_regex, template), "\n", -1)
    # explode of one element: filters on the parts stay above it, so the match runs once
    return kept.select("*", F.explode(F.array(parts)).alias("__f"))


def _quads(parsed: DataFrame, fields: int) -> DataFrame:
    part = [F.col("__f")[i] for i in range(fields)]
    s_iri, s_blank, p, o_iri, o_blank, text, lang, dt = part[:8]
    s = F.when(s_iri != "", unescape(s_iri)).otherwise(_scoped(s_blank))
    o = (
        F.when(o_iri != "", term(IRI, unescape(o_iri)))
        .when(o_blank != "", term(BLANK, _scoped(o_blank)))
        .otherwise(term(LITERAL, unescape(text), F.lower(lang),
                        F.when(lang != "", LANG_STRING).when(dt != "", unescape(dt)).otherwise(XSD_STRING)))
    )
    if fields > 8:
        g = F.when(part[8] != "", unescape(part[8])).when(part[9] != "", F.concat(F.lit("_:"), _scoped(part[9])))
    else:
        g = F.lit(None).cast("string")
    return parsed.select(
        g.alias("g"), s.alias("s"), F.when(s_iri != "", IRI).otherwise(BLANK).cast("byte").alias("s_kind"),
        unescape(p).alias("p"), o.alias("o"), "source_idx", "file_idx")


def _read(lines: DataFrame, line_regex: str, fields: int, mode: str):
    parsed = _parsed(lines, line_regex, fields)
    good = F.size("__f") == fields
    if mode == "failfast":
        message = F.concat(F.lit("cannot parse line of source "), F.col("source_idx").cast("string"),
                           F.lit(" file "), F.col("file_idx").cast("string"), F.lit(": "), F.col("line"))
        checked = parsed.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(message)))
        return _quads(checked, fields)
    if mode == "quarantine":
        rejects = parsed.filter(~good).select("source_idx", "file_idx", "line")
        return _quads(parsed.filter(good), fields), rejects
    raise ValueError("mode must be 'failfast' or 'quarantine'")


def read_ntriples(lines: DataFrame, graph: str | None = None, mode: str = "failfast"):
    """Quads of N-Triples lines.  ``failfast`` stops the job at the first bad line without
    a second pass; ``quarantine`` returns ``(quads, rejected lines)``."""
    made = _read(lines, NTRIPLES_LINE, 8, mode)
    if graph is None:
        return made
    if mode == "quarantine":
        return made[0].withColumn("g", F.lit(graph)), made[1]
    return made.withColumn("g", F.lit(graph))


def read_nquads(lines: DataFrame, mode: str = "failfast"):
    """Quads of N-Quads lines; the graph is the optional fourth term."""
    return _read(lines, NQUADS_LINE, 10, mode)


def read_turtle(spark: SparkSession, files: DataFrame, mode: str = "failfast"):
    return parse_turtle(spark, files, mode)


def assign_graph(quads: DataFrame, sources: DataFrame) -> DataFrame:
    """The graph of the line, else the graph of its source, else the default graph."""
    rows = [tuple(r) for r in sources.select("source_idx", "graph").distinct().toLocalIterator()]
    table = lookup(quads.sparkSession, rows, "source_idx int, __graph string")
    joined = quads.join(table, "source_idx", "left")
    return joined.select(F.coalesce("g", "__graph").alias("g"), "s", "s_kind", "p", "o",
                         "source_idx", "file_idx")


def read_quads(spark: SparkSession, manifest: DataFrame, mode: str = "failfast"):
    """All files of a manifest as one quad table, each by the reader of its format."""
    made, rejects = [], []
    for fmt in sorted(r["format"] for r in manifest.select("format").distinct().collect()):
        files = manifest.filter(F.col("format") == fmt)
        if fmt == "nt":
            got = read_ntriples(read_lines(spark, files), mode=mode)
        elif fmt == "nq":
            got = read_nquads(read_lines(spark, files), mode=mode)
        else:
            got = read_turtle(spark, files, mode)
        if mode == "quarantine":
            rejects.append(got[1])
            got = got[0]
        made.append(got)
    quads = assign_graph(reduce(lambda a, b: a.unionByName(b), made), manifest)
    if mode == "quarantine":
        return quads, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rejects)
    return quads
