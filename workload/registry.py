"""Registered queries with the plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.fixtures import EX, table_quads
from quadloom.operators import from_graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def graph(spark: SparkSession, sf: str, graphs: list[str], *tables: str) -> DataFrame:
    return from_graphs(table_quads(spark, sf, *tables), graphs)


def one_graph(spark: SparkSession, sf: str, *tables: str) -> DataFrame:
    """Triples of tables that share no triple, so the merge needs no duplicate removal."""
    return table_quads(spark, sf, *tables).select("s", "s_kind", "p", "o")


def iri(table: str, key: str) -> str:
    """SQL text of an entity IRI."""
    return f"('{EX}{table}/' || CAST({key} AS VARCHAR))"


CUST, NAT, REG, SUPP = (iri("customer", "c_custkey"), iri("nation", "n_nationkey"),
                        iri("region", "r_regionkey"), iri("supplier", "s_suppkey"))
ORD, PART, DOC = iri("order", "o_orderkey"), iri("part", "p_partkey"), iri("document", "d.doc_id")
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"
