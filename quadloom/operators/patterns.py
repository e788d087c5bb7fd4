"""Graph patterns over a quad table, and the operators on one table of bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup
from ..terms import (
    IRI, RDF_TYPE, TERM, Iri, Lit, Node, Var, blank_term, iri_term, node_term, subject_term,
    typed_term,
)
from .modifiers import number_copies


# ---------------------------------------------------------------- dataset selection
def from_graphs(quads: DataFrame, graphs: list[str] | None = None) -> DataFrame:
    """The default graph of a query: the merge of the listed graphs (all when omitted).

    One graph holds distinct triples already, so no shuffle is needed.  Several graphs are
    merged as a set; a later filter on s, p or o is still pushed below this ``distinct``.
    """
    if graphs is not None and len(graphs) == 1:
        return quads.filter(F.col("g") == graphs[0]).select("s", "s_kind", "p", "o")
    kept = quads if graphs is None else quads.filter(F.col("g").isin(graphs))
    return kept.select("s", "s_kind", "p", "o").distinct()


def dataset(quads: DataFrame, default: str = "union") -> DataFrame:
    """``union``: all graphs together; ``unnamed``: only triples without a graph."""
    if default == "union":
        return from_graphs(quads)
    if default == "unnamed":
        return quads.filter(F.col("g").isNull()).select("s", "s_kind", "p", "o")
    raise ValueError("default must be 'union' or 'unnamed'")


def distinct_quads(quads: DataFrame) -> DataFrame:
    return quads.dropDuplicates(["g", "s", "s_kind", "p", "o"])


# ---------------------------------------------------------------- one pattern
def _bound(node: Node, position: str) -> Column:
    if position == "p":
        return F.col("p") == node.value
    if position == "s":
        return (F.col("s") == node.value) & (F.col("s_kind") == IRI)
    o = F.col("o")
    if isinstance(node, Iri):
        return (o["value"] == node.value) & (o["kind"] == IRI)
    want = Lit(node.value, node.dt, node.lang.lower())
    same = (o["value"] == want.value) & (o["kind"] == 2) & (o["lang"] == want.lang)
    return same if want.lang else same & (o["dt"] == want.dt)


def pattern(graph: DataFrame, s: Node, p: Node, o: Node, g: Node | None = None) -> DataFrame:
    """Bindings of one triple (or, with ``g``, quad) pattern.

    Constants become plain column filters that reach the Parquet scan; a variable used
    twice becomes an equality filter.
    """
    # the object is rebuilt so that the schema knows it is never unbound: files only store
    # nullable columns, and joins treat a variable that may be unbound with more care
    o_term = F.struct(*[F.col("o")[f].alias(f) for f in TERM.names])
    makers = {
        "s": subject_term(), "p": iri_term(F.col("p")), "o": o_term, "g": iri_term(F.col("g")),
    }
    conditions: list[Column] = []
    columns: dict[str, Column] = {}
    for position, node in (("s", s), ("p", p), ("o", o), ("g", g)):
        if node is None:
            continue
        if position == "g" and isinstance(node, Iri):
            conditions.append(F.col("g") == node.value)
        elif position == "g":
            conditions.append(F.col("g").isNotNull())
        if isinstance(node, Var):
            if node.name in columns:
                conditions.append(columns[node.name] == makers[position])
            else:
                columns[node.name] = makers[position]
        elif position != "g":
            conditions.append(_bound(node, position))
    matched = graph
    for condition in conditions:
        matched = matched.filter(condition)
    if not columns:
        return matched.select()
    return matched.select(*[made.alias(name) for name, made in columns.items()])


def in_graph(quads: DataFrame, g: Node, s: Node, p: Node, o: Node) -> DataFrame:
    """``GRAPH g { s p o }``; triples without a graph never match."""
    return pattern(quads, s, p, o, g)


def instances(graph: DataFrame, class_iri: str, var: str = "s") -> DataFrame:
    return pattern(graph, Var(var), Iri(RDF_TYPE), Iri(class_iri))


# ---------------------------------------------------------------- bindings
def project(bindings: DataFrame, names: list[str]) -> DataFrame:
    """Keep the variables in the order written; one never bound becomes all-unbound."""
    have = set(bindings.columns)
    return bindings.select(*[
        F.col(n) if n in have else F.lit(None).cast(TERM).alias(n) for n in names
    ])


def extend(bindings: DataFrame, name: str, expression: Column, as_term: bool = False) -> DataFrame:
    """``BIND(expression AS ?name)``; ``as_term`` wraps a plain value as a literal."""
    out = bindings.withColumn(name, expression)
    return out.withColumn(name, typed_term(out, name)) if as_term else out


def where(bindings: DataFrame, condition: Column) -> DataFrame:
    """FILTER: rows whose condition is false or an error (NULL) are dropped."""
    return bindings.filter(condition)


def keyword_filter(bindings: DataFrame, var: str, text: str) -> DataFrame:
    return bindings.filter(F.contains(F.lower(F.col(var)["value"]), F.lower(F.lit(text))))


def expand_iri(c: Column, prefixes: dict[str, str]) -> Column:
    """Full IRI of a written term, NULL for literals, ``[]`` and unknown prefixes.

    ``prefixes`` maps a prefix, with or without its colon, to a namespace with or without
    angle brackets.
    """
    text = F.trim(c)
    split_at = F.locate(":", text)
    prefix = F.substring_index(text, ":", 1)
    local = F.substr(text, split_at + 1)
    pairs: dict[str, str] = {}
    for key, namespace in prefixes.items():
        bare = key[:-1] if key.endswith(":") else key
        if key.endswith(":") or bare not in pairs:
            pairs[bare] = str(namespace).removeprefix("<").removesuffix(">")
    if pairs:
        table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
        namespace = F.try_element_at(table, prefix)
    else:
        namespace = F.lit(None).cast("string")
    return (
        F.when((text == "") | (text == "[]") | text.rlike("^[\"']"), F.lit(None))
        .when(text.startswith("<") & text.endswith(">"),
              F.substr(text, F.lit(2), F.length(text) - 2))
        .when(text.startswith("http://") | text.startswith("https://"), text)
        .when(split_at > 0, F.concat(namespace, local))
    )


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Inline data: each cell is an ``Iri``, a ``Lit`` or None for UNDEF."""
    def cell(node):
        if node is None:
            return None
        if isinstance(node, Iri):
            return (IRI, node.value, "", "")
        dt = node.dt if not node.lang else "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
        return (2, node.value, node.lang.lower(), dt)
    schema = ", ".join(
        f"`{n}` struct<kind: tinyint, value: string, lang: string, dt: string>" for n in names)
    return lookup(spark, [tuple(cell(x) for x in row) for row in rows], schema)


def ask(bindings: DataFrame) -> bool:
    return not bindings.isEmpty()


def ask_result(bindings: DataFrame) -> DataFrame:
    """ASK as a one-row table, stopping at the first solution."""
    return bindings.limit(1).agg((F.count("*") > 0).alias("answer"))


# ---------------------------------------------------------------- graphs out of bindings
def _template_term(node, row_id: str) -> Column:
    if isinstance(node, Var):
        return F.col(node.name)
    if isinstance(node, str):  # a template-local blank node, fresh per solution
        return blank_term(F.concat(F.lit(f"{node}_"), F.col(row_id)))
    return node_term(node)


def construct(bindings: DataFrame, template: list[tuple]) -> DataFrame:
    """Triples made from every solution; incomplete or ill-formed triples are left out.

    A template entry given as a plain string is a blank node.  Its label is derived from
    the solution itself and a number among equal solutions, so all triples of one
    solution share it however often the plan is run.
    """
    row_id = "__solution"
    uses_blank = any(isinstance(x, str) for t in template for x in t)
    rows = bindings
    if uses_blank:
        digest = F.sha2(F.to_json(F.struct(*bindings.columns)), 256)
        counted = bindings.groupBy(*bindings.columns).agg(F.count("*").alias("__n"))
        copies = number_copies(counted.withColumn("__d", digest), "__n", "__k")
        rows = copies.withColumn(row_id, F.concat_ws("_", "__d", F.col("__k").cast("string")))
    entries = []
    for s, p, o in template:
        entries.append(F.struct(
            _template_term(s, row_id).alias("ts"), _template_term(p, row_id).alias("tp"),
            _template_term(o, row_id).alias("to")))
    made = rows.select(F.explode(F.array(*entries)).alias("t")).select("t.*")
    good = made.filter(
        F.col("ts").isNotNull() & F.col("tp").isNotNull() & F.col("to").isNotNull()
        & (F.col("ts")["kind"] != 2) & (F.col("tp")["kind"] == IRI))
    return good.select(
        F.col("ts")["value"].alias("s"), F.col("ts")["kind"].alias("s_kind"),
        F.col("tp")["value"].alias("p"), F.col("to").alias("o")).distinct()


def describe(graph: DataFrame, iris: DataFrame | list[str]) -> DataFrame:
    """All triples about the given resources, plus one step into their blank nodes."""
    if isinstance(iris, DataFrame):
        wanted = iris.select(F.col(iris.columns[0])["value"].alias("s")).distinct()
    else:
        wanted = lookup(graph.sparkSession, [(i,) for i in iris], "s string")
    named = graph.filter(F.col("s_kind") == IRI)
    direct = named.join(wanted, "s", "left_semi").select("s", "s_kind", "p", "o")
    nodes = direct.filter(F.col("o")["kind"] == 0).select(F.col("o")["value"].alias("s")).distinct()
    nested = graph.filter(F.col("s_kind") == 0).join(nodes, "s", "left_semi")
    return direct.unionByName(nested.select("s", "s_kind", "p", "o")).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
