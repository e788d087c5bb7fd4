"""Aggregation over bindings, with SPARQL rules for unbound and non-numeric values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import (
    XSD_DECIMAL, XSD_DOUBLE, XSD_FLOAT, XSD_INTEGER, decimal_of, double_of, literal_term,
    number_rank, order_key,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def triple_count(graph: DataFrame) -> DataFrame:
    """One row, 0 for an empty graph."""
    return graph.agg(F.count("*").alias("count"))


def count(v) -> Column:
    return F.count(_c(v))


def count_distinct(v, approx: bool = False, rsd: float = 0.02) -> Column:
    made = F.approx_count_distinct(_c(v), rsd) if approx else F.count_distinct(_c(v))
    made.sketch, made.exact = approx, not approx  # told apart by ``group``
    return made


def minimum(v) -> Column:
    t = _c(v)
    return F.min(F.when(t.isNotNull(), F.struct(order_key(t).alias("k"), t.alias("t"))))["t"]


def maximum(v) -> Column:
    t = _c(v)
    return F.max(F.when(t.isNotNull(), F.struct(order_key(t).alias("k"), t.alias("t"))))["t"]


def sample(v) -> Column:
    return F.first(_c(v), ignorenulls=True)


def number_term(rank: Column, integer: Column, decimal: Column, double: Column) -> Column:
    """A numeric literal of the given promotion rank; NULL where its value is NULL."""
    exact = F.regexp_replace(
        F.regexp_replace(decimal.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    floating = F.replace(double.cast("string"), F.lit("Infinity"), F.lit("INF"))
    return (
        F.when(rank.isNull(), F.lit(None))
        .when((rank == 0) & integer.isNotNull(), literal_term(integer.cast("string"), XSD_INTEGER))
        .when((rank == 1) & decimal.isNotNull(), literal_term(exact, XSD_DECIMAL))
        .when((rank == 2) & double.isNotNull(), literal_term(floating, XSD_FLOAT))
        .when((rank == 3) & double.isNotNull(), literal_term(floating, XSD_DOUBLE))
    )


def sum_term(v) -> Column:
    """SUM: 0 for no values, unbound when a value is not a number."""
    t = _c(v)
    n, good = F.count(t), F.count(double_of(t))
    rank = F.when(n == 0, 0).when(n == good, F.max(number_rank(t)))
    whole = F.coalesce(F.try_sum(decimal_of(t, "decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return number_term(rank, whole, F.try_sum(decimal_of(t)), F.sum(double_of(t)))


def avg_term(v) -> Column:
    """AVG: 0 for no values, unbound when a value is not a number."""
    t = _c(v)
    n, good = F.count(t), F.count(double_of(t))
    rank = F.when(n == 0, 0).when(n == good, F.greatest(F.max(number_rank(t)), F.lit(1)))
    # each input has scale 9, so the mean keeps at least nine exact decimals
    mean = F.try_divide(F.try_sum(decimal_of(t, "decimal(28,9)")), n.cast("decimal(19,0)"))
    return number_term(rank, F.lit(0), mean, F.avg(double_of(t)))


def group_concat(v, sep: str = " ", distinct: bool = False, sort: bool = True) -> Column:
    """The texts of a group in one string; sorted, so that equal inputs give equal output.

    The result is one value holding the whole group, as the function is defined.
    """
    text = _c(v)["value"]
    made = F.listagg_distinct(text, F.lit(sep)) if distinct and not sort else None
    if made is None:
        items = F.collect_set(text) if distinct else F.collect_list(text)
        made = F.array_join(F.sort_array(items) if sort else items, sep)
    return F.coalesce(made, F.lit(""))


def group(bindings: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """GROUP BY with named aggregates; no keys gives exactly one row.

    Next to an exact distinct count Spark groups by the counted value first, with a sketch of
    some kB for each value: sketches are then made in a grouping of their own.
    """
    apart = {n: c for n, c in aggregates.items() if vars(c).get("sketch")}
    if apart and any(vars(c).get("exact") for c in aggregates.values()):
        here = group(bindings, keys, **{n: c for n, c in aggregates.items() if n not in apart})
        there = group(bindings, keys, **apart)
        if not keys:
            return here.crossJoin(there).select(*aggregates)
        there = there.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return here.join(there, reduce(lambda a, b: a & b, same)).select(*keys, *aggregates)
    made = [c.alias(name) for name, c in aggregates.items()]
    return bindings.groupBy(*keys).agg(*made) if keys else bindings.agg(*made)


def having(grouped: DataFrame, condition: Column) -> DataFrame:
    return grouped.filter(condition)
