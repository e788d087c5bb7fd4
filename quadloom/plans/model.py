"""Entity models: from a written model to tables and nested documents of the graph."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import slug
from ..operators.joins import star
from ..operators.modifiers import row_index
from ..operators.paths import path_alt, path_seq
from ..operators.patterns import instances
from ..session import lookup, materialise
from ..terms import RDF_TYPE, Iri, iri_term, node_term, subject_term

# --- fixed values ---
ALL_ATTRIBUTES_QUERY = "databaseinfo__all_attributes"
#: A count in braces or a repetition sign at the end of a key.
MODEL_MARKS = re.compile(r"[+*?]?(\{[^}]+\})?$")
#: <iri>, http(s) IRI, or prefix:local; a literal or a blank node is none of them.
IRI_FORMS = re.compile(r"<(?P<bracketed>.*)>|(?P<plain>https?://.*)|(?P<prefix>[^\"':\[][^:]*|):(?P<local>.*)", re.S)
# --- end of fixed values ---

SPEC = ("config string, subject string, class_iri string, attribute string, "
        "paths array<array<string>>, ref string")


@dataclass(frozen=True)
class Attribute:
    config: str
    subject: str
    class_iri: str
    attribute: str
    paths: tuple[tuple[str, ...], ...]
    ref: str | None = None


# ---------------------------------------------------------------- written model
BLANK, CLASS_KEY = "[]", "a"


def key_paths(node, above: tuple = ()):
    """Every (keys from the top, value) pair of a nested value; lists add no key."""
    for item in node if isinstance(node, list) else [node]:
        for key, value in item.items() if isinstance(item, dict) else ():
            here = (*above, MODEL_MARKS.sub("", str(key).strip()))
            yield here, value
            yield from key_paths(value, here)


def expanded(word: str, prefixes: dict) -> str | None:
    """The IRI a word of a model stands for: written out, in brackets, or with a known prefix."""
    m = IRI_FORMS.fullmatch(word.strip())
    if m is None:
        return None
    if m["local"] is None:
        return m["bracketed"] or m["plain"]
    space = prefixes.get(m["prefix"] + ":", prefixes.get(m["prefix"]))
    return None if space is None else str(space).strip("<>") + m["local"]


def _attribute(keys: tuple, prefixes: dict) -> tuple[str, tuple] | None:
    """(name, predicates) when the last key names an attribute and all before it are predicates."""
    name, steps = keys[-1], [k for k in keys[:-1] if k != BLANK]
    iris = tuple(expanded(k, prefixes) if ":" in k else None for k in steps)
    named = name not in ("", BLANK, CLASS_KEY) and ":" not in name
    return (name, iris) if named and iris and None not in iris else None


def flatten_model(model, prefixes: dict, config: str = "model") -> list[Attribute]:
    """One entry per (subject, attribute) with all its predicate paths.

    A subject without a class or without attributes is left out; a later subject of the
    same name replaces an earlier one.  An attribute whose example names a subject of the
    model refers to it.
    """
    entries = [(str(key).split()[0], blocks) for entry in (model if isinstance(model, list) else [])
               if isinstance(entry, dict) for key, blocks in entry.items()
               if str(key).split() and isinstance(blocks, list)]
    subjects = {name for name, _ in entries}
    kept: dict[str, list[Attribute]] = {}
    for subject, blocks in entries:
        rows = list(key_paths(blocks))
        classes = {iri for keys, value in rows if keys == (CLASS_KEY,)
                   for word in (value if isinstance(value, list) else str(value).split(","))
                   if (iri := expanded(str(word), prefixes))}
        found: dict[str, dict] = {}
        for keys, value in rows:
            if hit := _attribute(keys, prefixes):
                found.setdefault(hit[0], {"example": value, "paths": {}})["paths"][hit[1]] = None
        if classes and found:
            kept[subject] = [
                Attribute(config, subject, min(classes), name, tuple(got["paths"]),
                          next((w for w in str(got["example"]).split()[:1]
                                if isinstance(got["example"], str) and w in subjects), None))
                for name, got in sorted(found.items())]
    return [a for rows in kept.values() for a in rows]


def model_spec(spark: SparkSession, spec: list[Attribute]) -> DataFrame:
    rows = [(a.config, a.subject, a.class_iri, a.attribute, [list(p) for p in a.paths], a.ref)
            for a in spec]
    return lookup(spark, rows, SPEC)


# ---------------------------------------------------------------- tables of one subject
def _of(spec: list[Attribute], subject: str) -> list[Attribute]:
    mine = [a for a in spec if a.subject == subject]
    if not mine:
        raise ValueError(f"no subject {subject} in the model")
    return mine


def _find(spec: list[Attribute], subject: str, attribute: str) -> Attribute:
    for a in _of(spec, subject):
        if a.attribute == attribute:
            return a
    raise ValueError(f"no attribute {attribute} of {subject}")


def _pairs(graph: DataFrame, a: Attribute) -> DataFrame:
    """``(entity, value)`` over all paths of an attribute."""
    single = [p[0] for p in a.paths if len(p) == 1]
    frames = [path_alt(graph, single)] if single else []
    frames += [path_seq(graph, list(p)) for p in a.paths if len(p) > 1]
    made = reduce(lambda x, y: x.unionByName(y), frames)
    return made.select(F.col("s").alias("entity"), F.col("o").alias("value"))


def class_table(graph: DataFrame, spec: list[Attribute], subject: str) -> DataFrame:
    return instances(graph, _of(spec, subject)[0].class_iri, "entity")


def attribute_table(graph: DataFrame, spec: list[Attribute], subject: str, attribute: str) -> DataFrame:
    """``(entity, value)`` of one attribute of the instances of a subject's class."""
    a = _find(spec, subject, attribute)
    return _pairs(graph, a).join(instances(graph, a.class_iri, "entity"), "entity", "left_semi")


def attribute_facts(graph: DataFrame, spec: list[Attribute]) -> DataFrame:
    """Every attribute of every subject in one long table, from one pass over the graph.

    All one-step paths share a single scan that looks the predicate up in the model; the
    class of the entity is checked once for all of them.
    """
    spark = graph.sparkSession
    one = [(a.config, a.subject, a.attribute, a.class_iri, p[0])
           for a in spec for p in a.paths if len(p) == 1]
    names = ["config", "subject", "attribute"]
    frames = []
    if one:
        table = lookup(spark, one, "config string, subject string, attribute string, class_iri string, p string")
        scanned = graph.filter(F.col("p").isin(sorted({r[4] for r in one})))
        frames.append(scanned.join(table, "p").select(
            *names, "class_iri", subject_term().alias("entity"), F.col("o").alias("value")))
    for a in spec:
        for path in a.paths:
            if len(path) > 1:
                frames.append(path_seq(graph, list(path)).select(
                    F.lit(a.config).alias("config"), F.lit(a.subject).alias("subject"),
                    F.lit(a.attribute).alias("attribute"), F.lit(a.class_iri).alias("class_iri"),
                    F.col("s").alias("entity"), F.col("o").alias("value")))
    facts = reduce(lambda x, y: x.unionByName(y), frames)
    classes = sorted({a.class_iri for a in spec})
    types = graph.filter((F.col("p") == RDF_TYPE) & F.col("o")["value"].isin(classes)).select(
        subject_term().alias("entity"), F.col("o")["value"].alias("class_iri"))
    return facts.join(types, ["entity", "class_iri"], "left_semi").select(*names, "entity", "value")


# ---------------------------------------------------------------- named tables
def default_parameters(parameters) -> dict[str, object]:
    """Parameters of a named table with their defaults; a plain list has empty defaults."""
    if isinstance(parameters, dict):
        return {str(k): v for k, v in parameters.items()}
    if isinstance(parameters, list):
        return {str(k): "" for k in parameters}
    return {}


def _restrict(df: DataFrame, params: dict) -> DataFrame:
    for name, given in params.items():
        nodes = given if isinstance(given, (list, tuple)) else [given]
        nodes = [n for n in nodes if n not in ("", None)]
        if name in df.columns and nodes:
            terms = [node_term(Iri(n) if isinstance(n, str) else n) for n in nodes]
            df = df.filter(reduce(lambda a, b: a | b, [F.col(name) == t for t in terms]))
    return df


def entity_table(graph: DataFrame, spec: list[Attribute], variables: list[str],
                 params: dict | None = None, functional: tuple[str, ...] = ()) -> DataFrame:
    """A wide table over a subject, its attributes and the subjects they refer to.

    The first subject named is the centre; another subject is reached through the
    attribute that refers to it.  ``params`` binds a variable to one or several terms and is
    applied before the joins.  ``functional`` names attributes with at most one value.
    """
    params = params or {}
    subjects = [v for v in variables if any(a.subject == v for a in spec)]
    if not subjects:
        raise ValueError("a table needs at least one subject of the model")

    centre, reached, links = subjects[0], {subjects[0]}, {}
    for other in subjects[1:]:
        link = next((a for a in spec if a.ref == other and a.subject in reached), None)
        if link is None:
            raise ValueError(f"nothing in the table refers to {other}")
        links[other] = link
        reached.add(other)

    # columns get neutral names, since variables may differ in case only
    column: dict[tuple[str, str | None], str] = {}

    def name_of(subject: str, attribute: str | None) -> str:
        return column.setdefault((subject, attribute), f"__v{len(column)}")

    def block(subject: str) -> DataFrame:
        mine = _of(spec, subject)
        needed = {l.attribute for l in links.values() if l.subject == subject}
        wanted = [a for a in mine if a.attribute in variables or a.attribute in needed]
        bound = {name_of(subject, a.attribute): params[a.attribute] for a in wanted if a.attribute in params}
        me = name_of(subject, None)
        if subject in params:
            bound[me] = params[subject]
        simple = {name_of(subject, a.attribute): a.paths[0][0] for a in wanted
                  if len(a.paths) == 1 and len(a.paths[0]) == 1}
        fixed = tuple(name_of(subject, a.attribute) for a in wanted
                      if a.attribute in functional and name_of(subject, a.attribute) in simple)
        if simple:
            out = star(graph, simple, mine[0].class_iri, me, fixed)
        else:
            out = instances(graph, mine[0].class_iri, me)
        out = _restrict(out, bound)
        for a in wanted:
            mark = name_of(subject, a.attribute)
            if mark not in simple:
                pairs = _pairs(graph, a).select(F.col("entity").alias(me), F.col("value").alias(mark))
                out = out.join(_restrict(pairs, bound), me)
        return out

    out = block(centre)
    for other, link in links.items():
        right = block(other)
        me = name_of(other, None)
        out = out.withColumn(me, F.col(name_of(link.subject, link.attribute))).join(right, me)
    chosen = []
    for v in variables:
        place = next(((s, k) for s, k in column if (k is None and s == v) or k == v), None)
        if place is not None:
            chosen.append((column[place], v))
    return out.select(*[c for c, _ in chosen]).toDF(*[v for _, v in chosen])


# ---------------------------------------------------------------- nested documents
def documents(graph: DataFrame, spec: list[Attribute], subject: str, depth: int = 1,
              iris: list[str] | None = None, part_size: int = 10_000) -> DataFrame:
    """One nested document per entity: ``(entity, part, doc)``.

    Attributes are arrays of texts; a reference is its IRI with the document of what it
    refers to, ``depth`` levels deep.  An entity with more than ``part_size`` values of an
    attribute is written as several numbered parts that together hold all values, so no
    row or task collects an unbounded group.
    """
    only = None
    if iris is not None:
        wanted = lookup(graph.sparkSession, [(i,) for i in iris], "iri string")
        only = wanted.select(iri_term(F.col("iri")).alias("entity"))
    return _documents(graph, spec, subject, depth, only, part_size)


def _documents(graph, spec, subject, depth, only, part_size) -> DataFrame:
    mine = _of(spec, subject)
    known = {a.subject for a in spec}
    refs = [a.attribute for a in mine if a.ref in known and depth > 0]
    members = instances(graph, mine[0].class_iri, "entity")
    facts = attribute_facts(graph, mine).select("entity", "attribute", "value")
    if only is not None:
        members = members.join(only, "entity", "left_semi")
        facts = facts.join(only, "entity", "left_semi")
    facts = materialise(facts, "facts")  # read several times below; the graph only once
    large = facts.groupBy("entity", "attribute").agg(F.count("*").alias("__n")).filter(
        F.col("__n") > part_size)
    spread = F.pmod(F.xxhash64("value"), F.ceil(F.col("__n") / part_size))
    facts = facts.join(large, ["entity", "attribute"], "left").select(
        "entity", "attribute", "value", F.coalesce(spread, F.lit(0)).cast("int").alias("__part"))
    column = {a.attribute: f"__a{i}" for i, a in enumerate(mine)}
    plain = [a.attribute for a in mine if a.attribute not in refs]
    frames = [members.select("entity", F.lit(0).alias("__part"))]
    if plain:
        text = F.col("value")["value"]
        frames.append(facts.filter(F.col("attribute").isin(plain)).select("entity", "__part", *[
            F.when(F.col("attribute") == name, text).alias(column[name]) for name in plain]))
    for a in mine:
        if a.attribute in refs:
            links = facts.filter(F.col("attribute") == a.attribute).select("entity", "__part", "value")
            narrowed = None
            if only is not None:
                narrowed = links.select(F.col("value").alias("entity")).distinct()
            below = _documents(graph, spec, a.ref, depth - 1, narrowed, part_size).select(
                F.col("entity").alias("value"), F.col("doc").alias("__doc"))
            item = F.struct(F.col("value")["value"].alias("iri"), F.col("__doc").alias("document"))
            frames.append(links.join(below, "value", "left").select(
                "entity", "__part", item.alias(column[a.attribute])))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    grouped = rows.groupBy("entity", "__part").agg(*[
        F.sort_array(F.collect_list(c)).alias(c) for c in column.values()])
    doc = F.struct(F.col("entity")["value"].alias("iri"), *[F.col(c).alias(n) for n, c in column.items()])
    return grouped.select("entity", F.col("__part").alias("part"), doc.alias("doc"))


# ---------------------------------------------------------------- catalog of tables
def unique_names(df: DataFrame, base: str, position: str, out: str = "name") -> DataFrame:
    """The first use of a name keeps it, later ones get ``_1``, ``_2`` in order.

    A made-up name that equals a written one stops the job instead of hiding a table.
    Positions come from the distributed row index, so one frequent name is no bottleneck.
    """
    indexed = row_index(df, [base, position], out="__at")
    first = indexed.groupBy(base).agg(F.min("__at").alias("__first"))
    nth = F.col("__at") - F.col("__first")
    named = indexed.join(first, base).select(
        *df.columns, F.when(nth == 0, F.col(base)).otherwise(
            F.concat_ws("_", F.col(base), nth.cast("string"))).alias(out))
    uses = named.groupBy(out).agg(F.count("*").alias("__uses"))
    message = F.concat(F.lit("two tables are named "), F.col(out))
    return named.join(uses, out).filter(
        F.when(F.col("__uses") == 1, F.lit(True)).otherwise(F.raise_error(message))
    ).select(*df.columns, out)


def query_catalog(spark: SparkSession, spec: list[Attribute],
                  named: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """``(name, config, kind, subject, attribute)`` of every table the models give.

    ``named`` maps a configuration to its named tables.  A named table is skipped when its
    name is blank, reserved, or that of an attribute table of the same configuration.
    """
    rows = []
    configs = sorted({a.config for a in spec} | set(named or {}))
    for config in configs:
        for name in (named or {}).get(config, {}):
            rows.append((len(rows), config, "named", None, None, str(name)))
        for a in [a for a in spec if a.config == config]:
            rows.append((len(rows), config, "attribute", a.subject, a.attribute, None))
    df = lookup(spark, rows, "pos int, config string, kind string, subject string, "
                             "attribute string, query string")
    s = {c: slug(F.col(c)) for c in ("config", "subject", "attribute", "query")}
    is_named = F.col("kind") == "named"
    tail = F.when(is_named, s["query"]).otherwise(F.concat_ws("__", s["subject"], s["attribute"]))
    df = df.withColumn("__tail", tail)
    taken = df.filter(~is_named).select("config", "__tail").distinct()
    unfit = (F.trim("query") == "") | (F.col("query") == ALL_ATTRIBUTES_QUERY)
    kept = df.filter(is_named & ~unfit).join(taken, ["config", "__tail"], "left_anti").unionByName(
        df.filter(~is_named))
    based = kept.withColumn("__base", F.concat_ws("__", slug(F.col("config")), "__tail"))
    return unique_names(based, "__base", "pos").select("name", "config", "kind", "subject", "attribute")
