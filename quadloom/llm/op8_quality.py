"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Every document gets counts of its text and a vector of transformed statistics.  Per language
and source a minimum-covariance-determinant estimate is made from all documents that pass the
base rules: start from the documents nearest to the coordinate-wise medians, then repeat
concentration steps (mean and covariance of the nearest three quarters, new distances).
Documents with a large Mahalanobis distance are rejected.

Statistics are fixed-point integers, so sums, medians and decisions do not depend on the order
of rows.  Medians and cut-offs come from counts per bin, which are bounded per group however
many rows the group has.

Edge cases: a NULL text has no words and fails the base rules; NULL languages and sources form
groups of their own; in a group of one the document is kept unless the base rules fail it;
repeated rows count each; columns beside doc_id, text, lang and source stay or are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_SPACE_CLASS, SPACE_CLASS, materialise, words

SCALE = 1000
#: Least standard deviation of each statistic, in units of 1 / SCALE: groups whose documents
#: hardly differ do not reject on small differences.
FLOORS = {"x0": 100, "x1": 150, "x2": 120}
STATS = tuple(FLOORS)
PARTIAL = 0.75
STEPS = 2
CUT = 60.0  # squared distance; far beyond the chi-squared quantile of three statistics
GROUP = ["lang", "source"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    keep = [F.col(c) for c in docs.columns]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = [c for c, n in zip(keep, docs.columns) if n not in names]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(t, SPACE_CLASS + "+", "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NO_SPACE_CLASS))
    step = docs.select(*keep, words(F.col(text)).alias("_w"), lines.alias("_l"), F.length(bare).alias("_c"),
                       (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).alias("_s"))
    n = F.size("_w")
    window = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("_w", i, F.lit(5))))
    step = step.select(*keep, n.alias("_n"), "_c", "_s",
                       (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_d"),
                       F.when(n >= 5, window).alias("_h"))
    # documents without a repeated window (nearly all) go no further than the distinct count
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    order = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.select(*keep, "_n", "_c", "_s", "_d", F.when(repeated, order).alias("_o"))
    same = lambda j, k: F.coalesce(F.get("_o", j)["x"] == F.get("_o", k)["x"], F.lit(False))
    index = F.sequence(F.lit(0), F.size("_o") - 1)
    starts = F.array_sort(F.transform(
        F.filter(index, lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get("_o", j)["i"]))
    step = step.select(*keep, "_n", "_c", "_s", "_d", F.when(F.col("_o").isNotNull(), starts).alias("_p"))
    # words covered by windows of five that begin at the sorted positions
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - p, F.lit(5))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    long = lambda c: F.col(c).cast("bigint")
    done = step.select(*keep, long("_n").alias("n_words"), long("_c").alias("word_chars"),
                       long("_s").alias("n_symbols"), long("_d").alias("n_dup_lines"),
                       F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    return done.withColumn("base_failed", (F.col("n_words") < 10) | (
        100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vectors() -> list[Column]:
    """Transformed statistics: log mean word length, root symbol rate, root share of repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = (F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n),
         F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(v * SCALE).cast("bigint").alias(name) for v, name in zip(x, STATS)]


def _same(left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[g].eqNullSafe(right[f"_{g}"]) for g in GROUP])


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with the parameters of their group: a small table, sent to the rows when it is."""
    renamed = params.select(*[F.col(g).alias(f"_{g}") for g in GROUP],
                            *[c for c in params.columns if c not in GROUP])
    return rows.join(renamed, _same(rows, renamed), "left").drop(*[f"_{g}" for g in GROUP])


def _quantile(bins: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """Smallest ``bin`` below which (inclusive) at least ``share`` of the ``n`` rows lie."""
    order = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (bins.withColumn("_c", F.sum("n").over(order)).withColumn("_n", F.sum("n").over(W.partitionBy(*keys)))
            .where(F.col("_c") >= share * F.col("_n")).groupBy(*keys).agg(F.min("bin").alias(name)))


def _medians(rows: DataFrame) -> DataFrame:
    """Per group the medians m_x and median deviations s_x of every statistic."""
    def wide(long_rows: DataFrame, name: str) -> DataFrame:
        return long_rows.groupBy(*GROUP).agg(
            *[F.max(F.when(F.col("stat") == x, F.col(name))).alias(f"{name}_{x}") for x in STATS])

    stacked = rows.select(*GROUP, F.explode(F.array(*[
        F.struct(F.lit(x).alias("stat"), F.col(x).alias("bin")) for x in STATS])).alias("v")).select(*GROUP, "v.*")
    bins = stacked.groupBy(*GROUP, "stat", "bin").agg(F.count("*").alias("n"))
    middle = wide(_quantile(bins, [*GROUP, "stat"], 0.5, "m"), "m")
    off = _with(rows, middle).select(*GROUP, F.explode(F.array(*[
        F.struct(F.lit(x).alias("stat"), F.abs(F.col(x) - F.col(f"m_{x}")).alias("bin")) for x in STATS])).alias("v"))
    bins = off.select(*GROUP, "v.*").groupBy(*GROUP, "stat", "bin").agg(F.count("*").alias("n"))
    return _with(middle, wide(_quantile(bins, [*GROUP, "stat"], 0.5, "s"), "s"))


def _start_distance() -> Column:
    terms = [((F.col(x) - F.col(f"m_{x}")) / F.greatest(1.4826 * F.col(f"s_{x}"), F.lit(float(FLOORS[x])))) ** 2
             for x in STATS]
    return reduce(lambda a, b: a + b, terms)


def distance() -> Column:
    """Squared Mahalanobis distance from c_x under the inverse matrix i_xy."""
    d = {x: F.col(x) - F.col(f"c_{x}") for x in STATS}
    pairs = [(x, y) for k, x in enumerate(STATS) for y in STATS[k:]]
    return reduce(lambda a, b: a + b, [
        F.col(f"i_{x}{y}") * d[x] * d[y] * (1.0 if x == y else 2.0) for x, y in pairs])


def _estimate(rows: DataFrame, d: Column) -> DataFrame:
    """Mean and inverse covariance per group over the rows nearest by ``d``."""
    binned = rows.withColumn("bin", F.floor(100 * F.log2(1 + d)).cast("bigint"))
    bins = binned.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"))
    near = _with(binned, _quantile(bins, GROUP, PARTIAL, "cut")).where("bin <= cut")
    pairs = [(x, y) for k, x in enumerate(STATS) for y in STATS[k:]]
    sums = near.groupBy(*GROUP).agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"t_{x}") for x in STATS],
        *[F.sum(F.col(x) * F.col(y)).alias(f"t_{x}{y}") for x, y in pairs])
    mean = {x: F.col(f"t_{x}") / F.col("n") for x in STATS}
    cov = {}
    for x, y in pairs:
        v = F.col(f"t_{x}{y}") / F.col("n") - mean[x] * mean[y]
        # consistency factor of the three-quarter subset, then the floor on the diagonal
        cov[x, y] = cov[y, x] = 1.9 * v + (F.lit(float(FLOORS[x] ** 2)) if x == y else F.lit(0.0))
    a, b, c = STATS
    cofactor = {(x, y): cov[_rest(x)[0], _rest(y)[0]] * cov[_rest(x)[1], _rest(y)[1]]
                - cov[_rest(x)[0], _rest(y)[1]] * cov[_rest(x)[1], _rest(y)[0]] for x, y in pairs}
    sign = {(x, y): (-1.0) ** (STATS.index(x) + STATS.index(y)) for x, y in pairs}
    det = cov[a, a] * cofactor[a, a] - cov[a, b] * cofactor[a, b] + cov[a, c] * cofactor[a, c]
    return sums.select(*GROUP, *[mean[x].alias(f"c_{x}") for x in STATS],
                       *[(sign[x, y] * cofactor[x, y] / det).alias(f"i_{x}{y}") for x, y in pairs])


def _rest(x: str) -> list[str]:
    return [s for s in STATS if s != x]


def estimate(counted: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates per language and source from a table with the counts of ``with_counts``."""
    rows = materialise(counted.where(~F.col("base_failed")).select(*GROUP, *vectors()), "vectors")
    params = materialise(_estimate(_with(rows, _medians(rows)), _start_distance()), "estimate")
    for _ in range(steps):
        params = materialise(_estimate(_with(rows, params), distance()), "estimate")
    return params


def judged(counted: DataFrame, params: DataFrame, cut: float = CUT) -> DataFrame:
    """``counted`` with its distance and ``kept``."""
    rows = _with(counted.withColumns({x: v for x, v in zip(STATS, vectors())}), params)
    rows = rows.withColumn("distance", distance())
    near = F.coalesce(F.col("distance") <= cut, F.lit(True))
    return (rows.withColumn("kept", ~F.col("base_failed") & near)
            .drop(*STATS, *[c for c in params.columns if c not in GROUP]))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query, with the squared distance."""
    counted = materialise(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    return judged(counted, estimate(counted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    counted = materialise(with_counts(docs), "counted")
    return judged(counted, estimate(counted)).where("kept").select(*docs.columns)
