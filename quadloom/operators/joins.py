"""Joins between tables of bindings, with the semantics of unbound variables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import LOOKUP_ROWS
from ..terms import Iri, Var, subject_term
from .patterns import instances, pattern

Triple = tuple


# ---------------------------------------------------------------- helpers
def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    have = set(right.columns)
    return [c for c in left.columns if c in have]


def _nullable(frame: DataFrame, name: str) -> bool:
    return frame.schema[name].nullable


def _subsets(names: list[str]):
    for size in range(len(names), -1, -1):
        yield from (set(c) for c in combinations(names, size))


def _mask(frame: DataFrame, maybe: list[str], bound: set[str]) -> DataFrame:
    for name in maybe:
        c = F.col(name)
        frame = frame.filter(c.isNotNull() if name in bound else c.isNull())
    return frame


def _masks(frame: DataFrame, maybe: list[str]):
    """Split on which of ``maybe`` are bound; a column that cannot be null stays whole."""
    open_names = [n for n in maybe if _nullable(frame, n)]
    fixed = set(maybe) - set(open_names)
    for bound in _subsets(open_names):
        yield bound | fixed, _mask(frame, open_names, bound)


def _renamed(frame: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        frame = frame.withColumnRenamed(name, f"__r_{name}")
    return frame


def _on(keys: list[str], condition: Column | None) -> Column:
    parts = [F.col(k) == F.col(f"__r_{k}") for k in keys]
    if condition is not None:
        parts.append(condition)
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def _unsure(left: DataFrame, right: DataFrame, shared: list[str], bound) -> list[str]:
    return [c for c in shared
            if c not in bound and (_nullable(left, c) or _nullable(right, c))]


def product(left: DataFrame, right: DataFrame, max_rows: int = 1) -> DataFrame:
    """Pairs of two unrelated tables, only when the right one is counted to be small.

    The usual case is a one-row aggregate next to each solution, hence the default.  The
    count bounds the broadcast; two large unrelated tables are refused.
    """
    if max_rows > LOOKUP_ROWS:
        raise ValueError(f"max_rows is at most {LOOKUP_ROWS}")
    n = right.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"product refused: the right side has more than {max_rows} rows")
    return left.join(F.broadcast(right), F.lit(True), "inner")


# ---------------------------------------------------------------- compatible join
def compatible_join(left: DataFrame, right: DataFrame, bound: tuple[str, ...] = (),
                    allow_product: bool = False) -> DataFrame:
    """Join where a shared variable matches if it is equal or unbound on either side.

    Variables the schema (or ``bound``) says are never unbound are ordinary equi-join
    keys.  For the others, rows are split by which variables they bind and every pair of
    splits is an equi-join on what both bind, so no join has an OR condition.
    """
    shared = _shared(left, right)
    out_columns = left.columns + [c for c in right.columns if c not in shared]
    if not shared:
        if not allow_product:
            raise ValueError("no shared variable: ask for product() explicitly")
        return product(left, right)
    maybe = _unsure(left, right, shared, bound)
    sure = [c for c in shared if c not in maybe]
    if not maybe:
        return left.join(right, shared, "inner").select(*out_columns)
    pieces = []
    for left_bound, left_rows in _masks(left, maybe):
        for right_bound, right_rows in _masks(right, maybe):
            both = left_bound & right_bound
            keys = sure + [c for c in maybe if c in both]
            renamed = _renamed(right_rows, shared)
            if keys:
                joined = left_rows.join(renamed, _on(keys, None), "inner")
            else:
                if left_rows.isEmpty() or right_rows.isEmpty():
                    continue
                if not allow_product:
                    raise ValueError("rows without any common bound variable: a product")
                joined = product(left_rows, renamed)
            pieces.append(joined.select(*[
                F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in maybe else F.col(c)
                for c in out_columns
            ]))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def _split_matches(left: DataFrame, right: DataFrame, condition: Column | None, bound,
                   need_common: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Left rows with and without a compatible right row.

    The right side is reduced to its distinct keys first, so a hot key on it is gone
    before the join; adaptive execution may split a hot key of the left side.
    """
    shared = _shared(left, right)
    maybe = _unsure(left, right, shared, bound)
    sure = [c for c in shared if c not in maybe]
    hit, miss = [], []
    for left_bound, rest in _masks(left, maybe):
        for right_bound, right_rows in _masks(right, maybe):
            keys = sure + [c for c in maybe if c in left_bound and c in right_bound]
            if not keys:
                if need_common:
                    continue
                if condition is not None:
                    raise ValueError("a condition needs at least one common bound variable")
                if not right_rows.isEmpty():
                    hit.append(rest)
                    rest = rest.limit(0)
                continue
            if condition is None:
                other = _renamed(right_rows.select(*keys).distinct(), keys)
            else:
                other = _renamed(right_rows, shared)
            on = _on(keys, condition)
            hit.append(rest.join(other, on, "left_semi"))
            rest = rest.join(other, on, "left_anti")
        miss.append(rest)
    return hit, miss


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    if not frames:
        return like.limit(0)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def minus(left: DataFrame, right: DataFrame, bound: tuple[str, ...] = ()) -> DataFrame:
    """Drop left rows compatible with a right row they share a bound variable with."""
    if not _shared(left, right):
        return left
    return _union(_split_matches(left, right, None, bound, need_common=True)[1], left)


def exists(left: DataFrame, right: DataFrame, negate: bool = False,
           condition: Column | None = None, bound: tuple[str, ...] = ()) -> DataFrame:
    """FILTER EXISTS / NOT EXISTS against the bindings of a pattern group."""
    if not _shared(left, right):
        if condition is not None:
            raise ValueError("a condition needs at least one common variable")
        return left if right.isEmpty() == negate else left.limit(0)
    hit, miss = _split_matches(left, right, condition, bound, need_common=False)
    return _union(miss if negate else hit, left)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None,
             bound: tuple[str, ...] = (), skew_safe: bool | None = None) -> DataFrame:
    """OPTIONAL: keep every left row, with the compatible right rows where there are any.

    ``condition`` is the filter inside the optional group; it may use variables of both
    sides.  ``skew_safe`` writes the outer join as matches plus non-matches: an inner join can
    be split on either side when one key holds a large share of the rows, a left outer join
    only on the left, and the non-matches need only the distinct right keys.  It is the
    default without a condition; with one, the non-matches need the whole right side and a
    plain outer join is the default.
    """
    shared = _shared(left, right)
    if not shared:
        raise ValueError("OPTIONAL needs a shared variable")
    if skew_safe is None:
        skew_safe = condition is None
    out_columns = left.columns + [c for c in right.columns if c not in shared]
    maybe = _unsure(left, right, shared, bound)
    if not maybe and not skew_safe:
        joined = left.join(_renamed(right, shared), _on(shared, condition), "left")
        return joined.select(*out_columns)
    if not maybe:
        matched = left.join(_renamed(right, shared), _on(shared, condition), "inner")
        matched = matched.select(*out_columns)
    else:
        matched = compatible_join(left, right, bound)
        if condition is not None:
            matched = matched.filter(condition)
    missed = _union(_split_matches(left, right, condition, bound, need_common=False)[1], left)
    return matched.unionByName(missed, allowMissingColumns=True)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def reduce_by(bindings: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keep rows whose keys occur in ``other``, before a larger join uses them."""
    return bindings.join(other.select(*keys).distinct(), keys, "left_semi")


# ---------------------------------------------------------------- basic graph patterns
def _variables(triple: Triple) -> set[str]:
    return {n.name for n in triple if isinstance(n, Var)}


def pattern_counts(graph: DataFrame, patterns: list[Triple]) -> dict[str, int]:
    """Triples per constant predicate of the patterns: at most one row per pattern."""
    wanted = sorted({t[1].value for t in patterns if isinstance(t[1], Iri)})
    found = graph.filter(F.col("p").isin(wanted)).groupBy("p").agg(F.count("*").alias("n"))
    return {r["p"]: r["n"] for r in found.collect()}


def order_patterns(patterns: list[Triple], counts: dict[str, int]) -> list[Triple]:
    """Smallest predicate first, then always one connected to what is joined already."""
    def size(t):
        p = t[1].value if isinstance(t[1], Iri) else None
        guess = counts.get(p, max(counts.values(), default=0)) if p else sum(counts.values())
        constants = sum(1 for n in (t[0], t[2]) if not isinstance(n, Var))
        return guess / (1000 ** constants)
    rest = sorted(patterns, key=size)
    chosen = [rest.pop(0)]
    known = _variables(chosen[0])
    while rest:
        linked = next((t for t in rest if _variables(t) & known), rest[0])
        rest.remove(linked)
        chosen.append(linked)
        known |= _variables(linked)
    return chosen


def bgp(graph: DataFrame, patterns: list[Triple], counts: dict[str, int] | None = None) -> DataFrame:
    """Inner join of triple patterns on their shared variables.

    With ``counts`` (rows per predicate, from ``predicate_counts``) the patterns are put in
    a connected order starting from the smallest; otherwise the order given is kept.
    """
    ordered = order_patterns(patterns, counts) if counts else list(patterns)
    out = pattern(graph, *ordered[0])
    waiting = ordered[1:]
    while waiting:
        nxt = next((t for t in waiting if _variables(t) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("the patterns are not connected; use product() explicitly")
        waiting.remove(nxt)
        right = pattern(graph, *nxt)
        keys = [c for c in out.columns if c in right.columns]
        if set(right.columns) == set(keys):
            # a pattern that binds nothing new only restricts; triples are a set
            out = out.join(right, keys, "left_semi")
        else:
            out = out.join(right, keys, "inner")
    return out


def star(graph: DataFrame, attributes: dict[str, str], class_iri: str | None = None,
         subject: str = "s", functional: tuple[str, ...] = ()) -> DataFrame:
    """One row per combination of values of several predicates of one subject.

    Attributes named in ``functional`` (at most one value per subject, as told by
    ``predicate_counts``) are read together in one scan and one aggregation of fixed-size
    state; a subject with a second value stops the job instead of losing it.  Every other
    attribute, and the class, is a join on the subject.  All joins share the subject key, so
    the rows are shuffled once per input and the partitioning is reused along the chain.
    """
    unknown = set(functional) - set(attributes)
    if unknown:
        raise ValueError(f"not attributes: {sorted(unknown)}")
    if subject in attributes:
        raise ValueError(f"{subject} is the subject: choose another name for the attribute")
    fused = {a: p for a, p in attributes.items() if a in functional}
    out = None
    if len(fused) > 1:
        wanted = list(dict.fromkeys(fused.values()))
        rows = graph.filter(F.col("p").isin(wanted))
        found = []
        for name, p in fused.items():
            mine = F.col("p") == p
            n = F.count(F.when(mine, 1))
            value = F.max(F.when(mine, F.col("o")))
            found.append(F.when(
                n > 1, F.raise_error(F.lit(f"{name} has several values for one subject"))
            ).otherwise(value).alias(name))
        # grouped by the term itself, so that the joins below reuse this partitioning
        out = rows.groupBy(subject_term().alias(subject)).agg(*found).dropna(subset=list(fused))
    for name, p in attributes.items():
        if out is not None and name in out.columns:
            continue
        one = pattern(graph, Var(subject), Iri(p), Var(name))
        out = one if out is None else out.join(one, subject, "inner")
    if class_iri is not None:
        members = instances(graph, class_iri, subject)
        out = members if out is None else out.join(members, subject, "left_semi")
    return out.select(subject, *attributes)


def mutual_pairs(graph: DataFrame, predicate: str, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs linked in both directions, each once with ``str(a) < str(b)``.

    Both directions of a pair meet in one group of at most two rows: one shuffle on the
    pair, no self-join on a possibly hot resource.
    """
    links = pattern(graph, Var("x"), Iri(predicate), Var("y")).filter(
        F.col("x")["value"] != F.col("y")["value"])
    forward = F.col("x")["value"] < F.col("y")["value"]
    pairs = links.select(
        F.when(forward, F.col("x")).otherwise(F.col("y")).alias(a),
        F.when(forward, F.col("y")).otherwise(F.col("x")).alias(b),
        forward.alias("__forward"))
    both = pairs.groupBy(a, b).agg(
        F.bool_or("__forward").alias("__f"), F.bool_or(~F.col("__forward")).alias("__r"))
    return both.filter("__f AND __r").select(a, b)
