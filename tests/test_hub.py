"""One subject with a third of all links: results stay whole and no row holds the whole group."""

import pytest
from pyspark.sql import functions as F

from quadloom import operators as op
from quadloom.plans import model, quality
from quadloom.session import materialise
from quadloom.terms import RDF_TYPE, Iri, Var, iri_term

N, SUBJECTS = 30_000, 2_000
V = Var


@pytest.fixture(scope="module")
def graph(spark):
    ids = spark.range(N)
    other = F.concat(F.lit("s"), (F.col("id") % SUBJECTS).cast("string"))
    links = ids.select(F.when(F.col("id") % 3 == 0, "hub").otherwise(other).alias("s"), F.lit("p").alias("p"),
                       F.concat(F.lit("o"), F.col("id").cast("string")).alias("v"))
    names = spark.range(SUBJECTS).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"), F.lit("name").alias("p"), F.lit("N").alias("v"))
    names = names.unionByName(spark.createDataFrame([("hub", "name", "H")], "s string, p string, v string"))
    types = names.select("s", F.lit(RDF_TYPE).alias("p"), F.lit("C").alias("v"))
    rows = links.unionByName(names).unionByName(types)
    return materialise(rows.select("s", F.lit(1).cast("byte").alias("s_kind"), "p", iri_term(F.col("v")).alias("o")), "hub")


def test_star_and_optional(graph):
    assert op.star(graph, {"name": "name", "v": "p"}, "C", functional=("name",)).count() == N
    named = op.pattern(graph, V("s"), Iri("name"), V("n"))
    for safe in (True, False):
        assert op.optional(named, op.pattern(graph, V("s"), Iri("p"), V("v")), skew_safe=safe).count() == N


def test_pages_of_a_hot_value(graph):
    pages = op.paginate(op.pattern(graph, V("s"), Iri("p"), V("v")).select("s"), ["s"], 1000)
    assert sorted(map(tuple, pages.groupBy("page").count().collect())) == [(i, 1000) for i in range(N // 1000)]


def test_documents_in_bounded_parts(graph):
    spec = [model.Attribute("c", "C", "C", "name", (("name",),)), model.Attribute("c", "C", "C", "v", (("p",),))]
    docs = model.documents(graph, spec, "C", 0, part_size=500)
    hub = docs.filter(F.col("entity")["value"] == "hub").agg(
        F.count("*"), F.sum(F.size("doc.v")), F.max(F.size("doc.v")), F.sum(F.size("doc.name"))).first()
    assert hub[0] == 20 and hub[1] == N // 3 and hub[2] < 700 and hub[3] == 1
    assert docs.agg(F.sum(F.size("doc.v"))).first()[0] == N


def test_statistics(graph):
    counts = {r["p"]: (r["triples"], r["subjects"], r["objects"]) for r in quality.predicate_counts(graph).collect()}
    assert counts["p"] == (N, SUBJECTS + 1, N) and counts["name"] == (SUBJECTS + 1, SUBJECTS + 1, 2)
