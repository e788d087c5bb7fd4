"""Property paths: every function returns pairs of terms named ``s`` and ``o``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path
from ..terms import iri_term, subject_term


SENT_ROWS = 100_000


def _pairs(graph: DataFrame) -> DataFrame:
    return graph.select(subject_term().alias("s"), F.col("o"))


def path_step(graph: DataFrame, predicate: str) -> DataFrame:
    return _pairs(graph.filter(F.col("p") == predicate))


def path_alt(graph: DataFrame, predicates: list[str]) -> DataFrame:
    """``p1|p2``: one row per matching triple."""
    return _pairs(graph.filter(F.col("p").isin(list(predicates))))


def path_inv(pairs: DataFrame) -> DataFrame:
    """``^path``: literals cannot be subjects of a match, but may be starting points."""
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))


def path_neg(graph: DataFrame, predicates: list[str]) -> DataFrame:
    """``!(p1|p2)``: any predicate but these."""
    return _pairs(graph.filter(~F.col("p").isin(list(predicates))))


def path_seq(graph: DataFrame, steps: list) -> DataFrame:
    """``p1/p2/...``; a step is a predicate or an already built pairs frame.

    Duplicates are kept: one row per way through the graph.
    """
    frames = [path_step(graph, s) if isinstance(s, str) else s for s in steps]
    out = frames[0]
    for nxt in frames[1:]:
        left = out.select("s", F.col("o").alias("__mid"))
        right = nxt.select(F.col("s").alias("__mid"), "o")
        out = left.join(right, "__mid").select("s", "o")
    return out


def nodes(graph: DataFrame) -> DataFrame:
    """Every subject and object, as the zero-length path pairs."""
    ends = graph.select(F.explode(F.array(subject_term(), F.col("o"))).alias("s")).distinct()
    return ends.select("s", F.col("s").alias("o"))


class _Rounds:
    """Frames stored in one scratch folder, each counted by the job that writes it."""

    def __init__(self, spark):
        self.spark, self.base, self.n = spark, scratch_path(spark, "closure"), 0

    def write(self, frame: DataFrame) -> tuple[DataFrame, int, str]:
        path, seen = f"{self.base}/{self.n}", Observation()
        self.n += 1
        frame.observe(seen, F.count("*").alias("n")).write.parquet(path)
        return self.read(frame.schema, [path]), seen.get["n"], path

    def read(self, schema, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("s", F.col("o").alias("__mid")).join(
        right.select(F.col("s").alias("__mid"), "o"), "__mid").select("s", "o")


def _hinted(pairs: DataFrame, n: int) -> DataFrame:
    """Sent to every task only while it is short: rounds are many, and file sizes tell little of rows."""
    return pairs if n <= SENT_ROWS else pairs.hint("merge")


def _swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))


def _walk(edges: DataFrame, start: DataFrame | None, max_steps: int | None, rounds: _Rounds) -> DataFrame:
    """One step a round, from the pairs found last: for given starts or few steps."""
    hops, links, _ = rounds.write(edges)
    delta, new, path = rounds.write(hops if start is None else hops.join(start, "s", "left_semi"))
    schema, known, total = delta.schema, [path], new
    while new > 0 and (max_steps is None or len(known) < max_steps):
        grown = _join(delta, _hinted(hops, min(new, links))).distinct()
        delta, new, path = rounds.write(grown.join(_hinted(rounds.read(schema, known), total), ["s", "o"], "left_anti"))
        known.append(path)
        total += new
    return rounds.read(schema, known)


def _relabelled(pairs: DataFrame, labels: DataFrame, *sides: str) -> DataFrame:
    """``pairs`` with the nodes of the named columns replaced by their labels."""
    out = pairs
    for side in sides:
        to = labels.select(F.col("node").alias(side), F.col("label").alias("__label"))
        out = out.join(to, side, "left").withColumn(side, F.coalesce("__label", side)).drop("__label")
    return out


def _labels(mutual: DataFrame) -> DataFrame:
    """A common label for nodes that reach each other, one hop further than their own partners."""
    both = mutual.unionByName(_swapped(mutual))
    least = both.groupBy("s").agg(F.min("o").alias("o")).select(F.col("s").alias("node"), F.least("s", "o").alias("label"))
    return _relabelled(least, least.select("node", "label"), "label")


def _reachable(edges: DataFrame, rounds: _Rounds) -> DataFrame:
    """All pairs, paths twice as long every round, so the rounds grow with the logarithm of the
    longest path.

    A path longer than all known ones begins with a path found in the last round, so only
    these are extended, by all known.  Nodes found to reach each other are merged at once: a
    cycle of m nodes costs the m * m pairs that it has in the result and no more, and
    long ways through it are not found again and again.
    """
    loops, _, _ = rounds.write(edges.where("s = o").select(F.col("s").alias("node")))
    delta, new, path = rounds.write(edges.where("s <> o"))
    schema, known, members, total = delta.schema, [path], None, new
    while new > 0:
        pairs = _hinted(rounds.read(schema, known), total)
        mutual, merged, _ = rounds.write(delta.join(_swapped(pairs), ["s", "o"], "left_semi"))
        if merged:
            labels, _, _ = rounds.write(_labels(mutual))
            if members is None:
                members = labels
            else:
                moved = _relabelled(members, labels, "label")
                members, _, _ = rounds.write(moved.unionByName(labels.join(moved.select("node"), "node", "left_anti")))
            delta, new, path = rounds.write(_relabelled(pairs, labels, "s", "o").where("s <> o").distinct())
            known, total = [path], new
            continue
        grown = _join(delta, pairs)
        if members is not None:  # merging shortens paths unevenly: either half may be the new one
            grown = grown.unionByName(_join(pairs, delta))
        delta, new, path = rounds.write(grown.distinct().join(pairs, ["s", "o"], "left_anti"))
        known.append(path)
        total += new
    pairs = rounds.read(schema, known)
    if members is None:
        return pairs.unionByName(loops.select(F.col("node").alias("s"), F.col("node").alias("o")))
    inside = members.select("label", F.col("node").alias("s")).join(
        members.select("label", F.col("node").alias("o")), "label").select("s", "o")
    apart = loops.join(members, "node", "left_anti").select(F.col("node").alias("s"), F.col("node").alias("o"))
    back = members.select(F.col("label").alias("node"), F.col("node").alias("label"))
    return _relabelled(pairs, back, "s", "o").select("s", "o").unionByName(inside).unionByName(apart)


def _numbered(edges: DataFrame, rounds: _Rounds) -> tuple[DataFrame, DataFrame]:
    """``(node, id)`` and the distinct edges between the numbers, for rounds that move no terms."""
    edges, _, _ = rounds.write(edges)
    nodes = edges.select(F.explode(F.array("s", "o")).alias("node")).where("node IS NOT NULL").distinct()
    ids, _, _ = rounds.write(nodes.select("node", F.monotonically_increasing_id().alias("id")))
    return ids, _mapped(edges, ids, "node", "id", "s", "o").distinct()


def _mapped(pairs: DataFrame, ids: DataFrame, old: str, new: str, *sides: str) -> DataFrame:
    for side in sides:
        pairs = pairs.join(ids.select(F.col(old).alias(side), F.col(new).alias("__new")), side, "left").drop(
            side).withColumnRenamed("__new", side)
    return pairs.select(*sides)


def path_closure(graph: DataFrame, step, min_steps: int = 1, start: DataFrame | None = None,
                 max_steps: int | None = None) -> DataFrame:
    """``p+`` (``min_steps=1``), ``p*`` (0) or ``p?`` (0 with ``max_steps=1``), as a set.

    Every round is written to the shared scratch folder, so a lost executor repeats at most
    one round and the plan never grows.  ``start`` (a one-column frame of terms) limits
    the walk to paths from these resources, which are then followed step by step.
    """
    edges = (path_step(graph, step) if isinstance(step, str) else step).select("s", "o")
    rounds = _Rounds(graph.sparkSession)
    if start is not None:
        start = start.select(F.col(start.columns[0]).alias("s")).distinct()
    if max_steps == 1:
        found = _walk(edges.distinct(), start, max_steps, rounds)
    else:
        ids, hops = _numbered(edges, rounds)
        if start is None and max_steps is None:
            found = _reachable(hops, rounds)
        else:
            first = None if start is None else _mapped(start, ids, "node", "id", "s")
            found = _walk(hops, first, max_steps, rounds)
        found = _mapped(found, ids, "id", "node", "s", "o")
    if min_steps == 0:
        zero = nodes(graph) if start is None else start.select("s", F.col("s").alias("o"))
        found = found.unionByName(zero).distinct()
    return found


def rename(pairs: DataFrame, s: str, o: str) -> DataFrame:
    return pairs.select(F.col("s").alias(s), F.col("o").alias(o))


def starts(iri_list_frame: DataFrame, column: str) -> DataFrame:
    return iri_list_frame.select(iri_term(F.col(column)).alias("s"))
