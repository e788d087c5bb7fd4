"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are canonicalised: numbers, names and units become typed placeholders, punctuation is
dropped and A-Z lower-cased, one word staying one word.  Windows of eight canonical words are
hashed and joined with the windows of the benchmark; items shorter than that are one window.
For the matching windows the words behind the placeholders are compared: an occurrence with other
numbers or names matches when, over all its windows, equal slots of the item hold equal words in
the document and different ones different words.  Windows of the plain lower-cased words are joined as well, so a
copy in other letter case or line breaks matches word for word.  An item is found when at least half
of its windows match in either way.

Edge cases: NULL or empty texts have no windows; an item without words cannot be found; repeated
windows and rows count once per item and document row; documents with equal ids are told apart
by their text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, materialise

WIDTH = 8
SHARE = 0.5
BROADCAST_WINDOWS = 500_000  # about 20 MB
BROADCAST_DOCS = 500_000  # about 12 MB of ids of documents with a hit

# Units that may follow a number.
UNITS = ("km cm mm m kg g mg t l ml s ms min h kmh mph mi ft in lb lbs oz usd eur gbp percent percentage "
         "meters metres miles kilometers kilometres grams kilograms pounds dollars euros cents seconds minutes "
         "hours days weeks months years degrees liters litres watts volts").split()
# Placeholders; their first letter is a click sign, so no ordinary word equals them.
NUMBER, NAME, UNIT = "\u0298num", "\u0298name", "\u0298unit"
#: A number word may carry signs, separators and a currency or percent mark.
_NUMBER_WORD = rf"(?<![^\s])[(\[\"'$€£+-]*\d[\d.,:/]*[)\]\"'%.,;:!?$€£]*(?![^\s])"
#: A capitalised word after a word that does not end a sentence.
_NAME_WORD = r"\p{Lu}(?<=[\p{Ll}\d,;][ ]\p{Lu})[\p{L}'’-]*"
_UNIT_WORD = rf"(?i)(?<={NUMBER} )(?:{'|'.join(UNITS)})(?=[.,;:!?)]*(?:\s|$))"
_DROPPED = r"[^\p{L}\p{M}\p{N}\s-]+"


def canonical(text: Column) -> tuple[Column, Column]:
    """Canonical words and, word for word, the plain words behind them."""
    t = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(t, _NUMBER_WORD, NUMBER)
    marked = F.regexp_replace(marked, _NAME_WORD, NAME)
    marked = F.regexp_replace(marked, _UNIT_WORD, UNIT)
    # one use of each text: an expression that is named twice would be computed twice
    plain = lambda c: F.array_remove(F.split(
        ascii_lower(F.regexp_replace(c, _DROPPED, "")), SPACE_CLASS + "+"), "")
    return plain(marked), plain(t)


def _each(words: Column) -> Column:
    """Hash of every word; a window is hashed from these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(width: int) -> Column:
    """Hash of every window of ``width`` words, from the word hashes ``_t``; NULL when there are fewer."""
    n = F.size("_t")
    return F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice("_t", i, F.lit(width)))))


def _windows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """(key columns, width, at, h): one row per window of the given widths."""
    keys = [c for c in rows.columns if c != "_t"]
    out = None
    for width in widths:
        part = rows.select(*keys, F.posexplode(_hashes(width)).alias("at", "h")).withColumn("width", F.lit(width))
        out = part if out is None else out.unionByName(part)
    return out


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, items (number of windows), width, item_at, h and q (hashes of the template and of the
    plain words), window, plain of every window of the benchmark."""
    t, p = canonical(F.col("text"))
    items = benchmark.select("item_id", t.alias("_t"), p.alias("_p")).where(F.size("_t") > 0)
    width_of = F.least(F.size("_t"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("_t") - width_of + 1)
    rows = items.select("item_id", F.size(starts).alias("items"), width_of.alias("width"), "_t", "_p",
                        F.explode(starts).alias("i"))
    window, plain = F.slice("_t", F.col("i"), F.col("width")), F.slice("_p", F.col("i"), F.col("width"))
    return rows.select("item_id", "items", "width", (F.col("i") - 1).alias("item_at"),
                       F.xxhash64(_each(window)).alias("h"), F.xxhash64(_each(plain)).alias("q"),
                       window.alias("window"), plain.alias("plain"))


def _slots(window: Column, item: Column, doc: Column) -> Column:
    """(item word, document word) of the placeholders of a window."""
    pairs = F.transform(window, lambda w, k: F.when(
        w.isin(NUMBER, NAME, UNIT), F.struct(F.get(item, k).alias("a"), F.get(doc, k).alias("b"))))
    return F.filter(pairs, lambda x: x.isNotNull())


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, windows (of the item),
    matched, exact (matches with equal words), one row per document row and item found."""
    items = materialise(item_windows(benchmark, width), "item-windows")
    stats = items.groupBy("width").agg(F.count("*").alias("n")).collect()  # one row per width, at most 8
    if not stats:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, text_id bigint, item_id bigint, windows bigint, matched bigint, exact bigint")
    t, p = canonical(F.col("text"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    widths, ids = sorted(r.width for r in stats), ["doc_id", "text_id"]
    both = [_windows(base.select(*ids, _each(c).alias("_t")), widths).withColumn("plain", F.lit(flag))
            for c, flag in ((t, False), (p, True))]
    wanted = [items.select("width", F.col(c).alias("h"), F.lit(flag).alias("plain")) for c, flag in (("h", False), ("q", True))]
    keys = wanted[0].unionByName(wanted[1]).distinct()
    small = 2 * sum(r.n for r in stats) <= BROADCAST_WINDOWS
    hits = both[0].unionByName(both[1]).join(F.broadcast(keys) if small else keys, ["width", "h", "plain"], "left_semi")
    hits = materialise(hits, "window-hits")
    copied = hits.where("plain").select(*ids, "width", F.col("h").alias("q")).distinct().join(
        items.select("item_id", "items", "width", "q", "h"), ["width", "q"])
    copied = copied.select(*ids, "item_id", "items", F.struct("h", F.lit(True).alias("exact")).alias("hit"))
    hits = hits.where("not plain").drop("plain")
    # only documents with a hit are canonicalised again, for the words behind the placeholders; while
    # their ids are few they are sent to the texts, else texts are shuffled to them
    where = materialise(hits.select(*ids).distinct(), "hit-documents")
    where = F.broadcast(where) if where.count() <= BROADCAST_DOCS else where
    again = base.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_id", "_text_id").join(
        where, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_id") == F.col("text_id"))).drop("_id", "_text_id")
    plain = again.dropDuplicates(["doc_id", "text_id"]).select("doc_id", "text_id", p.alias("_p"))
    plain = plain.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "_p")
    both = hits.join(plain, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text_id")))
    both = both.select("doc_id", "text_id", "width", "h", "at",
                       F.slice("_p", F.col("at") + 1, F.col("width")).alias("doc_plain"))
    matched = both.join(items, ["width", "h"])
    slots = _slots(F.col("window"), F.col("plain"), F.col("doc_plain"))
    # windows of one occurrence of an item lie at one distance from its start; all the slots of an
    # occurrence must agree: no item word stands for two document words, nor the reverse
    occurrence = matched.select(
        "doc_id", "text_id", "item_id", "items", (F.col("at") - F.col("item_at")).alias("shift"), slots.alias("slots"),
        F.struct("h", (F.col("plain") == F.col("doc_plain")).alias("exact")).alias("hit")
    ).groupBy("doc_id", "text_id", "item_id", "items", "shift").agg(
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.collect_set("hit").alias("hits"))
    distinct = lambda part: F.size(F.array_distinct(F.transform("slots", lambda s: s[part])))
    consistent = (F.size("slots") == distinct("a")) & (F.size("slots") == distinct("b"))
    good = occurrence.select("doc_id", "text_id", "item_id", "items", F.explode(F.filter(
        "hits", lambda x: x["exact"] | consistent)).alias("hit"))
    good = good.unionByName(copied)
    per = good.groupBy("doc_id", "text_id", "item_id").agg(
        F.first("items").cast("bigint").alias("windows"), F.countDistinct("hit.h").alias("matched"),
        F.countDistinct(F.when(F.col("hit.exact"), F.col("hit.h"))).alias("exact"))
    found = per.where(F.col("matched") >= share * F.col("windows"))
    return found.select("doc_id", "text_id", "item_id", "windows", "matched", "exact")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the registered query: documents with the items they hold."""
    return find_items(docs, benchmark).select("doc_id", "item_id", "windows", "matched", "exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    bad = find_items(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_text_id"]),
                     "left_anti")
