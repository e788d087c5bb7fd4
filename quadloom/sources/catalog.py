"""Source catalog: which files to load, in which format, into which graph."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.modifiers import row_index
from ..session import lookup

# --- fixed values: keys, formats and compression suffixes of a catalog ---
SOURCE_KEYS = ("name", "path", "format", "graph")
DEFAULT_FORMAT = "ttl"
FORMATS = ("nt", "ttl", "nq")
COMPRESSIONS = ("gz", "bz2", "xz", "zst", "zstd")
# --- end of fixed values ---

SOURCES = "source_idx int, name string, path string, format string, graph string"


class CatalogError(ValueError):
    pass


def source_catalog(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The sources in the order written; unknown keys and an empty list are errors."""
    if not entries:
        raise CatalogError("the catalog lists no source")
    for i, entry in enumerate(entries):
        unknown = sorted(set(entry) - set(SOURCE_KEYS))
        if unknown:
            raise CatalogError(f"source #{i}: keys not known: {', '.join(unknown)}")
    rows = [(i, *(entry.get(k) for k in SOURCE_KEYS)) for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, SOURCES)


def normalize_format(c: Column) -> Column:
    """Trimmed format, the default for blank ones, NULL for an unknown one."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(bare == "", F.lit(DEFAULT_FORMAT)).when(bare.isin(*FORMATS), bare)


def validate_sources(sources: DataFrame) -> DataFrame:
    """The first problem of every faulty source, as ``(source_idx, error)``."""
    fmt = normalize_format(F.col("format"))
    where = F.concat(F.lit("source #"), F.col("source_idx").cast("string"))
    error = (
        F.when(fmt.isNull(), F.concat(where, F.lit(": unknown format (known: nq, nt, ttl)")))
        .when((fmt == "nq") & F.col("graph").isNotNull(),
              F.concat(where, F.lit(": nq lines name their own graphs, so leave graph out")))
        .when(F.col("path").isNull(), F.concat(where, F.lit(": no path given")))
    )
    return sources.select("source_idx", error.alias("error")).filter(F.col("error").isNotNull())


def checked_sources(sources: DataFrame) -> DataFrame:
    """The catalog with normalised formats; raises on the first faulty source."""
    first = validate_sources(sources).orderBy("source_idx").first()
    if first is not None:
        raise CatalogError(first["error"])
    return sources.withColumn("format", normalize_format(F.col("format")))


# ---------------------------------------------------------------- files
def glob_regex(pattern: str) -> str:
    """Regular expression of a path pattern: ``*`` stays in a folder, ``**/`` spans folders."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif ch == "*":
            out.append("[^/]*")
            i += 1
        elif ch == "?":
            out.append("[^/]")
            i += 1
        elif ch == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1:end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^/' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
            i += 1
    return "^" + "".join(out) + "$"


def _fixed_part(pattern: str) -> str:
    """The leading folders of a pattern that hold no wildcard."""
    if not re.search(r"[*?\[]", pattern):
        return pattern
    head = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    return head.rsplit("/", 1)[0] or "/"


def _located(path: str, config_dir: str) -> str:
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        return path
    joined = path if path.startswith("/") else f"{config_dir.rstrip('/')}/{path}"
    scheme, rest = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*:/+)?(.*)$", joined).groups()
    scheme = scheme or ""
    rooted = rest if rest.startswith("/") or scheme else "/" + rest
    return scheme + posixpath.normpath(rooted)


def _bare(c: Column) -> Column:
    """A file URI without its scheme when it is local, so that both spellings compare."""
    return F.regexp_replace(c, "^file:/+", "/")


def discover_files(spark: SparkSession, sources: DataFrame, config_dir: str = "/") -> DataFrame:
    """Files of every source with their position in path order, folder by folder.

    Only file metadata is read.  Spark's listing leaves out files of zero bytes and names
    beginning with a dot or an underscore.  ``file_idx`` comes from the distributed row index, so a
    source that holds most files is not sorted in one task.
    """
    listings = []
    catalog = sources.select("source_idx", "path").orderBy("source_idx").toLocalIterator()
    for entry in catalog:
        idx, pattern = entry["source_idx"], _located(entry["path"], config_dir)
        regex = glob_regex(re.sub("^file:/+", "/", pattern))
        try:
            found = (
                spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .load(_fixed_part(pattern))
                .select(F.lit(idx).alias("source_idx"), _bare(F.col("path")).alias("path"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
            )
        except Exception as error:  # the reader reports a missing folder as an analysis error
            if "PATH_NOT_FOUND" not in str(error):
                raise
            raise CatalogError(f"source #{idx}: nothing exists at {pattern}") from None
        plain = F.col("path")
        matched = found.filter(plain.rlike(regex))
        if matched.isEmpty():
            folder = regex[:-1] + "/.*$"
            if found.filter(plain.rlike(folder)).isEmpty():
                raise CatalogError(f"source #{idx}: nothing exists at {pattern}")
            raise CatalogError(f"source #{idx}: no file fits {pattern}")
        listings.append(matched.withColumn("__parts", F.split(plain, "/")))
    files = reduce(lambda a, b: a.unionByName(b), listings)
    numbered = row_index(files, ["source_idx", "__parts"], unique_rows=True, out="__at")
    first = numbered.groupBy("source_idx").agg(F.min("__at").alias("__first"))
    return numbered.join(first, "source_idx").select(
        "source_idx", (F.col("__at") - F.col("__first")).cast("int").alias("file_idx"),
        "path", "size", "mtime")


def staged_name(source_idx: Column, file_idx: Column, path: Column, fmt: Column) -> Column:
    """Name under which a file is known after decompression and format renaming."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^[^.]*(\..*)?$", 1)
    full = F.concat(F.lit("source_"), source_idx.cast("string"), F.lit("_"),
                    file_idx.cast("string"), suffix)
    plain = F.regexp_replace(full, r"\.(%s)$" % "|".join(COMPRESSIONS), "")
    renamed = F.concat(F.regexp_replace(plain, r"\.[^.]*$", ""), F.lit("."), fmt)
    return F.when(F.endswith(plain, F.concat(F.lit("."), fmt)), plain).otherwise(renamed)


def compression(path: Column) -> Column:
    """The compression suffix of a path, the empty string when there is none."""
    return F.regexp_extract(path, r"\.(%s)$" % "|".join(COMPRESSIONS), 1)


def listed(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files with the format and graph of their source."""
    rows = [tuple(r) for r in sources.select("source_idx", "format", "graph").toLocalIterator()]
    table = lookup(files.sparkSession, rows, "source_idx int, format string, graph string")
    return files.join(table, "source_idx")
