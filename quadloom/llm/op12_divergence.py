"""How far the sources of a language lie apart, term by term.

1. Inside ``mapInArrow`` Arrow kernels lower-case (A-Z), split at everything that is no letter,
   encode the terms as a dictionary and group by hash: partial counts for each language, source and
   term (occurrences and documents).
2. One shuffle by language and term merges them; terms in too few documents of their language go.
   Kept terms are dealt into shards of about ``CELLS`` counts (terms times sources).
3. A shard holds its terms as columns of a terms by sources matrix, next to the totals of all
   sources of the language, and gives its part of every sum and its own leaders.  Sums of the parts
   and a final ranking follow.

NULL text, lang or source is ''.  Repeated rows are documents of their own; a language without kept
terms still gives its pairs, with value 0.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What separates terms once A-Z are in lower case: all of ASCII but a-z.
GAPS = r"[\x00-\x60\x7B-\x7F]+"
SMOOTH = 5
CELLS = 500_000
HELD_ROWS = 200_000  # partial counts a task holds before it sends them
SLICE_BYTES = 2 << 20  # of text that is split at once
SCALE_STEPS = 3  # parts per 1000 ** 3


# ---------------------------------------------------------------- counts
def _batch_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of one batch, by Arrow kernels alone."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), GAPS)
    doc = pc.list_parent_indices(lists)
    encoded = pc.list_flatten(lists).dictionary_encode()
    table = pa.table({"doc": doc, "code": encoded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    rows = pa.table({
        "lang": lang.take(table["doc"].combine_chunks()), "source": source.take(table["doc"].combine_chunks()),
        "code": table["code"], "n": table["count_all"]})
    sums = rows.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    term = encoded.dictionary.take(sums["code"].combine_chunks())
    out = pa.table({"lang": sums["lang"], "source": sums["source"], "term": term,
                    "n": sums["n_sum"], "docs": sums["count_all"]})
    return out.filter(pc.not_equal(out["term"], ""))


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table({"lang": sums["lang"], "source": sums["source"], "term": sums["term"],
                     "n": sums["n_sum"], "docs": sums["docs_sum"]})


def _slices(batches):
    """Batches of whole texts, about ``SLICE_BYTES`` each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def _partial(batches):
    held, rows = [], 0
    for batch in _slices(batches):
        held.append(_batch_counts(*(batch.column(c) for c in ("lang", "source", "text"))))
        rows += held[-1].num_rows
        if rows >= HELD_ROWS:
            held = [_merged(held)]
            rows = held[0].num_rows
            if rows >= HELD_ROWS // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts merged to one row for each language, term and source, dealt by language and
    term: ``(lang, term, source, n, docs)``."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(_partial, "lang string, source string, term string, n bigint, docs bigint")
    return partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """Stored ``(lang, term, source, n)`` of the terms in ``least`` documents of their language.

    A term's documents are added up over its sources: every document has one source.
    """
    counts = term_counts(docs)
    documents = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return materialise(counts.withColumn("all", documents).where(F.col("all") >= least).select(
        "lang", "term", "source", "n"), "kept-terms")


# ---------------------------------------------------------------- divergences
def billionths(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(10^9 * count / total), exact in 64 bits for totals below 9 * 10^15 (count <= total):
    long division, three decimal digits a step."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out


def _shard(top: int):
    """One shard of a language: sums over its terms for all pairs of sources, leaders of each."""

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        sources = groups["source"].to_pylist()
        total = np.array(groups["total"].to_pylist(), np.int64)
        lang, size = groups["lang"][0].as_py(), groups["size"][0].as_py()
        every = int(groups["every"][0].as_py())
        place = {s: i for i, s in enumerate(sources)}
        code = terms["term"].combine_chunks().dictionary_encode()
        names = code.dictionary
        counts = np.zeros((len(sources), len(names)), np.int64)
        row = np.fromiter((place[s] for s in terms["source"].to_pylist()), np.int64, terms.num_rows)
        counts[row, code.indices.to_numpy()] = terms["n"].to_numpy()
        p = billionths(counts + SMOOTH, (total + SMOOTH * size)[:, None])
        q = billionths(counts.sum(axis=0) + SMOOTH, np.int64(every + SMOOTH * size))
        out = {"source": [], "part": [], "item": [], "value": []}

        def add(source, part, items, values):
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values

        by_name = np.argsort(np.array([x.encode() for x in names.to_pylist()], object), kind="stable")
        for i, source in enumerate(sources):
            gap = np.abs(p[i + 1:] - p[i]).sum(axis=1)
            add(source, "pair", sources[i + 1:], gap.tolist())
            over = by_name[((counts[i] > 0) & (p[i] > q))[by_name]]
            best = over[np.argsort(q[over] - p[i][over], kind="stable")[:top]]
            add(source, "term", names.take(pa.array(best)).to_pylist(), (p[i] - q)[best].tolist())
        return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()),
                         "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()),
                         "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})

    return run


def divergences(docs: DataFrame, least: int = 30, top: int = 50, cells: int = CELLS) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``.

    ``pair``: the distance of a source to each other source of its language, over all kept terms.
    ``term``: the ``top`` terms a source uses more than its language does, by how much.
    """
    kept = kept_terms(docs, least)
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("size"), F.sum("n").alias("every"))
    widths = groups.groupBy("lang").agg(F.count("*").alias("width"))
    shards = F.ceil(F.col("size") * F.col("width") / F.lit(cells)).cast("int")
    langs = sizes.join(widths, "lang").withColumn("shards", F.greatest(shards, F.lit(1)))
    langs = materialise(langs, "languages")
    groups = materialise(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")

    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn(
        "shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    beside = groups.join(langs, "lang").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    parts = dealt.select("lang", "shard", "term", "source", "n").groupBy("lang", "shard").cogroup(
        beside.select("lang", "shard", "source", "total", "size", "every").groupBy("lang", "shard")
    ).applyInArrow(_shard(top), "lang string, source string, part string, item string, value bigint")
    parts = materialise(parts, "divergence-parts")

    once = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    silent = groups.join(langs, "lang", "left_anti").select("lang", "source")  # languages without kept terms
    idle = silent.join(silent.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn(
        "value", F.lit(0).cast("long"))
    once = once.unionByName(idle)
    pairs = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.withColumn("part", F.lit("pair"))
    leaders = parts.where("part = 'term'")
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(place)).unionByName(
        leaders.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top), allowMissingColumns=True)
    return ranked.select("lang", "source", "part", "item", "value", "rank")
