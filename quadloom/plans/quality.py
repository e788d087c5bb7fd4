"""Statistics, shape rules and link consistency of a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import pattern
from ..session import lookup
from ..terms import IRI, LANG_STRING, LITERAL, RDF_TYPE, XSD_STRING, Iri, Var, subject_term
from .model import Attribute, attribute_facts


# ---------------------------------------------------------------- statistics
def class_counts(graph: DataFrame) -> DataFrame:
    """Distinct entities per class."""
    typed = graph.filter(F.col("p") == RDF_TYPE)
    return typed.groupBy(F.col("o")["value"].alias("class_iri")).agg(
        F.count_distinct("s", "s_kind").alias("entities"))


def predicate_counts(graph: DataFrame) -> DataFrame:
    """Triples, distinct subjects and distinct objects per predicate.

    A predicate with as many subjects as triples is functional.  Two counts over different
    keys, each pre-aggregated, then joined per predicate.
    """
    per_s = graph.groupBy("p", "s", "s_kind").agg(F.count("*").alias("n")).groupBy("p").agg(
        F.sum("n").alias("triples"), F.count("*").alias("subjects"))
    per_o = graph.select("p", "o").distinct().groupBy("p").agg(F.count("*").alias("objects"))
    return per_s.join(per_o, "p")


def class_pairs(graph: DataFrame) -> DataFrame:
    """Sets of classes that occur together on one entity, with the number of entities."""
    typed = graph.filter(F.col("p") == RDF_TYPE)
    sets = typed.groupBy("s", "s_kind").agg(
        F.array_sort(F.collect_set(F.col("o")["value"])).alias("set"))
    several = sets.filter(F.size("set") > 1)
    return several.groupBy(F.array_join("set", " ").alias("classes")).agg(F.count("*").alias("entities"))


# ---------------------------------------------------------------- links
def inverse_violations(graph: DataFrame, forward: str, backward: str) -> DataFrame:
    """Links present in one direction only: ``(s, o, missing)`` in forward reading.

    Both directions of a link meet in one group of the pair, pre-aggregated: no join.
    """
    links = graph.filter(F.col("p").isin(forward, backward))
    ahead = F.col("p") == forward
    me = subject_term()
    turned = links.select(
        F.when(ahead, me).otherwise(F.col("o")).alias("s"),
        F.when(ahead, F.col("o")).otherwise(me).alias("o"), ahead.alias("__ahead"))
    seen = turned.groupBy("s", "o").agg(
        F.bool_or("__ahead").alias("__f"), F.bool_or(~F.col("__ahead")).alias("__b"))
    return seen.filter("NOT (__f AND __b)").select(
        "s", "o", F.when(F.col("__f"), backward).otherwise(forward).alias("missing"))


def one_way_links(graph: DataFrame, predicate: str) -> DataFrame:
    """Links of a symmetric predicate without the link back."""
    links = pattern(graph, Var("s"), Iri(predicate), Var("o")).filter(F.col("s") != F.col("o"))
    ahead = F.col("s")["value"] < F.col("o")["value"]
    pairs = links.select(
        F.when(ahead, F.col("s")).otherwise(F.col("o")).alias("a"),
        F.when(ahead, F.col("o")).otherwise(F.col("s")).alias("b"), ahead.alias("__ahead"))
    seen = pairs.groupBy("a", "b").agg(
        F.bool_or("__ahead").alias("__f"), F.bool_or(~F.col("__ahead")).alias("__b"))
    return seen.filter("NOT (__f AND __b)").select(
        F.when(F.col("__f"), F.col("a")).otherwise(F.col("b")).alias("s"),
        F.when(F.col("__f"), F.col("b")).otherwise(F.col("a")).alias("o"))


def dangling_refs(graph: DataFrame, spec: list[Attribute]) -> DataFrame:
    """Values of reference attributes that lack the class the model expects of them."""
    classes = {a.subject: a.class_iri for a in spec}
    refs = [a for a in spec if a.ref in classes]
    table = lookup(graph.sparkSession, [(a.config, a.subject, a.attribute, classes[a.ref]) for a in refs],
                   "config string, subject string, attribute string, want string")
    facts = attribute_facts(graph, refs).join(table, ["config", "subject", "attribute"])
    types = graph.filter((F.col("p") == RDF_TYPE) & F.col("o")["value"].isin(sorted(set(classes.values()))))
    typed = types.select(subject_term().alias("value"), F.col("o")["value"].alias("want"))
    return facts.join(typed, ["value", "want"], "left_anti").select(
        "subject", "attribute", "entity", "value")


# ---------------------------------------------------------------- shapes
@dataclass(frozen=True)
class Rule:
    """What a shape says about one predicate.

    ``kind`` is ``iri``, ``literal`` (with ``datatype``), ``shape`` (values must have the class of
    the shape ``ref``) or ``set`` (values must come from ``members``).
    """

    predicate: str
    kind: str
    datatype: str = ""
    ref: str = ""
    members: tuple[str, ...] = ()
    at_least: int = 1
    at_most: int | None = 1


@dataclass(frozen=True)
class Shape:
    name: str
    class_iri: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


RULES = ("shape string, predicate string, kind string, datatype string, want string, "
         "members array<string>, at_least int, at_most int")


def validate_shapes(graph: DataFrame, shapes: list[Shape], strict_datatype: bool = True) -> DataFrame:
    """Violations as ``(shape, focus, predicate, problem, n)``.

    One scan of the ruled predicates looks its rules up; values are checked and counted
    per (focus, predicate) with pre-aggregation.  ``strict_datatype=False`` lets
    language-tagged texts stand for plain strings.
    """
    spark = graph.sparkSession
    class_of = {s.name: s.class_iri for s in shapes}
    rows = [(s.name, r.predicate, r.kind, r.datatype, class_of.get(r.ref, ""), list(r.members),
             r.at_least, r.at_most) for s in shapes for r in s.rules]
    rules = lookup(spark, rows, RULES)
    kinds = lookup(spark, [(s.name, s.class_iri) for s in shapes], "shape string, class_iri string")

    types = graph.filter((F.col("p") == RDF_TYPE) & F.col("o")["value"].isin(sorted(class_of.values())))
    typed = types.select(subject_term().alias("focus"), F.col("o")["value"].alias("class_iri"))
    focus = typed.join(kinds, "class_iri").select("focus", "shape")

    used = graph.filter(F.col("p").isin(sorted({r[1] for r in rows}))).select(
        subject_term().alias("focus"), F.col("p").alias("predicate"), F.col("o").alias("value"))
    values = used.join(rules, "predicate").join(focus, ["focus", "shape"], "left_semi")

    v = F.col("value")
    dt_ok = v["dt"] == F.col("datatype")
    if not strict_datatype:
        dt_ok = dt_ok | ((F.col("datatype") == XSD_STRING) & (v["dt"] == LANG_STRING))
    ok = (
        F.when(F.col("kind") == "iri", v["kind"] == IRI)
        .when(F.col("kind") == "literal", (v["kind"] == LITERAL) & dt_ok)
        .when(F.col("kind") == "set", (v["kind"] == IRI) & F.array_contains("members", v["value"]))
        .otherwise(v["kind"] != LITERAL)
    )
    per_rule = values.groupBy("shape", "focus", "predicate").agg(
        F.count("*").alias("n"), F.count(F.when(~ok, 1)).alias("bad"))
    expected = focus.join(rules.select("shape", "predicate", "at_least", "at_most"), "shape")
    counted = expected.join(per_rule, ["shape", "focus", "predicate"], "left")
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    found = counted.select(
        "shape", "focus", "predicate",
        F.explode(F.array_compact(F.array(
            F.when(n < F.col("at_least"), F.struct(F.lit("too few values").alias("problem"), n.alias("n"))),
            F.when(n > F.col("at_most"), F.struct(F.lit("too many values").alias("problem"), n.alias("n"))),
            F.when(bad > 0, F.struct(F.lit("wrong kind of value").alias("problem"), bad.alias("n"))),
        ))).alias("x")).select("shape", "focus", "predicate", "x.problem", "x.n")

    refs = values.filter((F.col("kind") == "shape") & (v["kind"] != LITERAL)).select(
        "shape", "focus", "predicate", v.alias("value"), F.col("want"))
    targets = typed.select(F.col("focus").alias("value"), F.col("class_iri").alias("want"))
    missing = refs.join(targets, ["value", "want"], "left_anti").groupBy(
        "shape", "focus", "predicate").agg(F.count("*").alias("n"))
    return found.unionByName(missing.select(
        "shape", "focus", "predicate", F.lit("value lacks the class of its shape").alias("problem"), "n"))


# ---------------------------------------------------------------- dataset catalog
def dataset_catalog(spark: SparkSession, folder: str, endpoint_url: str, endpoint_name: str,
                    keyword_search_api: str) -> DataFrame:
    """One row per description file of a folder, unique names in order.

    Built anew from the folder each time, so a removed file is gone from the result.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]*)\.yaml$", 1)
    first_word = F.regexp_extract(stem, r"^\s*(\S+)", 1)
    names = files.select(first_word.alias("database")).filter("database <> ''").distinct()
    return names.select(
        "database", F.lit(endpoint_url).alias("endpoint_url"), F.lit(endpoint_name).alias("endpoint_name"),
        F.lit(keyword_search_api).alias("keyword_search_api")).orderBy("database")


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
