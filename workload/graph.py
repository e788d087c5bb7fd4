"""Patterns, joins and paths."""

from pyspark.sql import functions as F

from quadloom import functions as fn
from quadloom import operators as op
from quadloom.fixtures import COMMENT, EX, GEO, LABEL, PARTS, PREFIXES, TRADE, entity, table_quads
from quadloom.operators.paths import path_inv, path_step
from quadloom.terms import (
    RDF_TYPE, XSD_INTEGER, Iri, Lit, Var, iri_term, value_of, values,
)

from .registry import CUST, DOC, NAT, ORD, PART, REG, SUPP, graph, iri, one_graph, query

V, C = Var, F.col


def ex(name: str) -> Iri:
    return Iri(EX + name)


A = Iri(RDF_TYPE)

# ---------------------------------------------------------------- patterns


@query("full_scan", f"""
    SELECT {REG} AS s, '{RDF_TYPE}' AS p, '{EX}Region' AS o FROM region
    UNION ALL SELECT {REG}, '{LABEL}', r_name FROM region
    UNION ALL SELECT {NAT}, '{RDF_TYPE}', '{EX}Nation' FROM nation
    UNION ALL SELECT {NAT}, '{LABEL}', n_name FROM nation
    UNION ALL SELECT {NAT}, '{EX}region', {iri('region', 'n_regionkey')} FROM nation
    UNION ALL SELECT {SUPP}, '{RDF_TYPE}', '{EX}Supplier' FROM supplier
    UNION ALL SELECT {SUPP}, '{RDF_TYPE}', '{EX}Agent' FROM supplier
    UNION ALL SELECT {SUPP}, '{EX}name', s_name FROM supplier
    UNION ALL SELECT {SUPP}, '{EX}nation', {iri('nation', 's_nationkey')} FROM supplier
    UNION ALL SELECT {SUPP}, '{EX}balance', CAST(s_acctbal AS VARCHAR) FROM supplier""")
def full_scan(spark, sf):
    g = one_graph(spark, sf, "region", "nation", "supplier")
    return values(op.pattern(g, V("s"), V("p"), V("o")))


@query("bound_predicate", f"SELECT {CUST} AS c, c_name AS name FROM customer")
def bound_predicate(spark, sf):
    return values(op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name")))


@query("bound_object", f"SELECT {CUST} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def bound_object(spark, sf):
    return values(op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("segment"), Lit("BUILDING")))


@query("class_instances", f"SELECT {CUST} AS c FROM customer")
def class_instances(spark, sf):
    return values(op.instances(one_graph(spark, sf, "customer", "supplier"), EX + "Customer", "c"))


KNOWS_SQL = f"""knows AS (SELECT DISTINCT user_id AS a,
    ((CAST(floor(value) AS BIGINT) % n) + n) % n AS b
    FROM events, (SELECT max(user_id) + 1 AS n FROM events) WHERE event_type = 'click')"""


@query("repeated_variable", f"WITH {KNOWS_SQL} SELECT {iri('user', 'a')} AS x FROM knows WHERE a = b")
def repeated_variable(spark, sf):
    return values(op.pattern(one_graph(spark, sf, "events"), V("x"), ex("knows"), V("x")))


@query("from_one_graph", f"""
    SELECT p, count(*) AS n FROM (
      SELECT '{RDF_TYPE}' AS p FROM region UNION ALL SELECT '{LABEL}' FROM region
      UNION ALL SELECT '{RDF_TYPE}' FROM nation UNION ALL SELECT '{LABEL}' FROM nation
      UNION ALL SELECT '{EX}region' FROM nation) GROUP BY p""")
def from_one_graph(spark, sf):
    g = graph(spark, sf, [GEO], "region", "nation", "customer", "part")
    return g.groupBy("p").agg(F.count("*").alias("n"))


@query("from_merged_graphs", f"SELECT {NAT} AS n, n_name AS label FROM nation")
def from_merged_graphs(spark, sf):
    quads = table_quads(spark, sf, "nation")
    twice = quads.unionByName(quads.withColumn("g", F.lit(TRADE)))  # every triple in two graphs
    merged = op.from_graphs(twice, [GEO, TRADE])
    return values(op.pattern(merged, V("n"), Iri(LABEL), V("label")))


@query("graph_variable", f"""
    SELECT '{GEO}' AS g, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n
    UNION ALL SELECT '{PARTS}', (SELECT count(*) FROM part)
    UNION ALL SELECT '{TRADE}', 2 * (SELECT count(*) FROM customer)""")
def graph_variable(spark, sf):
    q = table_quads(spark, sf, "region", "nation", "customer", "part")
    b = op.in_graph(q, V("g"), V("s"), A, V("c"))
    return b.groupBy(value_of("g")).agg(F.count("*").alias("n"))


@query("union_dataset_by_class", f"""
    SELECT '{EX}Region' AS c, count(*) AS n FROM region UNION ALL SELECT '{EX}Part', count(*) FROM part""")
def union_dataset_by_class(spark, sf):
    g = op.dataset(table_quads(spark, sf, "region", "part"), "union")
    b = op.pattern(g, V("s"), A, V("c"))
    return b.groupBy(value_of("c")).agg(F.count("*").alias("n"))


@query("project_bag", "SELECT o_orderstatus AS status FROM orders")
def project_bag(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("status"), V("status"))
    return values(op.project(b, ["status"]))


@query("bind_expression", f"SELECT {ORD} AS o, round(o_totalprice * 2, 2) AS double_total FROM orders")
def bind_expression(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("total"), V("total"))
    b = op.extend(b, "twice", fn.multiply(F.col("total"), 2))
    return b.select(value_of("o"), F.round(fn.number(F.col("twice"), "double"), 2).alias("double_total"))


@query("filter_errors_dropped", f"SELECT {CUST} AS c FROM customer WHERE c_acctbal > 5000")
def filter_errors_dropped(spark, sf):
    # names and segments are not numbers: comparing them is an error, which drops the row
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), V("p"), V("v"))
    return values(op.where(b, fn.gt(F.col("v"), 5000)), "c")


@query("filter_negation_keeps_errors_out", f"SELECT {CUST} AS c FROM customer WHERE c_acctbal <= 5000")
def filter_negation(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), V("p"), V("v"))
    return values(op.where(b, ~fn.gt(F.col("v"), 5000)), "c")


@query("string_less_than", "SELECT c_name AS name FROM customer WHERE c_name < 'Customer#000000123'")
def string_less_than(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name"))
    return values(op.where(b, fn.lt(fn.str_(F.col("name")), "Customer#000000123")), "name")


@query("keyword_documents", f"SELECT {DOC} AS doc FROM documents d WHERE contains(lower(d.text), 'the ')")
def keyword_documents(spark, sf):
    b = op.pattern(one_graph(spark, sf, "documents"), V("doc"), Iri(COMMENT), V("text"))
    return values(op.keyword_filter(b, "text", "THE "), "doc")


@query("expand_names", f"""
    SELECT n_name AS name, CASE n_regionkey WHEN 0 THEN {NAT} WHEN 1 THEN 'http://x/' || n_name
      WHEN 2 THEN 'urn:' || n_name END AS iri FROM nation""")
def expand_names(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    written = (F.when(F.col("n_regionkey") == 0, F.concat(F.lit("ex:nation/"), F.col("n_nationkey").cast("string")))
               .when(F.col("n_regionkey") == 1, F.concat(F.lit("http://x/"), F.col("n_name")))
               .when(F.col("n_regionkey") == 2, F.concat(F.lit("<urn:"), F.col("n_name"), F.lit(">")))
               .when(F.col("n_regionkey") == 3, F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
               .otherwise(F.concat(F.lit("nope:"), F.col("n_name"))))
    return n.select(F.col("n_name").alias("name"), op.expand_iri(written, PREFIXES).alias("iri"))


@query("inline_values", f"""
    SELECT {CUST} AS c, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def inline_values(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("segment"), V("segment"))
    data = op.values(spark, ["segment"], [(Lit("BUILDING"),), (Lit("MACHINERY"),)])
    return values(op.compatible_join(b, data, bound=("segment",)))


@query("ask_debtors", "SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal < 0")
def ask_debtors(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("balance"), V("b"))
    return op.ask_result(op.where(b, fn.lt(F.col("b"), 0)))


@query("construct_region_links", f"""
    SELECT {CUST} AS s, '{EX}inRegion' AS p, {iri('region', 'n_regionkey')} AS o
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT {iri('region', 'n_regionkey')}, '{EX}active', 'yes'
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def construct_region_links(spark, sf):
    g = one_graph(spark, sf, "customer", "nation")
    b = op.bgp(g, [(V("c"), A, ex("Customer")), (V("c"), ex("nation"), V("n")), (V("n"), ex("region"), V("r"))])
    t = op.construct(b, [(V("c"), ex("inRegion"), V("r")), (V("r"), ex("active"), Lit("yes"))])
    return t.select("s", "p", F.col("o")["value"].alias("o"))


@query("construct_blank_nodes", "SELECT p, count(*) AS n, count(*) AS nodes FROM (SELECT '" + EX +
       "about' AS p FROM orders UNION ALL SELECT '" + EX + "note' FROM orders) GROUP BY p")
def construct_blank_nodes(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("status"), V("v")).select("v")
    t = op.construct(b, [("n", ex("about"), ex("Status")), ("n", ex("note"), V("v"))])
    return t.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("nodes"))


@query("describe_asia", f"""
    SELECT {NAT} AS s, '{RDF_TYPE}' AS p, '{EX}Nation' AS o FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT {NAT}, '{LABEL}', n_name FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT {NAT}, '{EX}region', '{EX}region/2' FROM nation WHERE n_regionkey = 2""")
def describe_asia(spark, sf):
    g = one_graph(spark, sf, "nation", "region", "customer")
    of_asia = op.pattern(g, V("n"), ex("region"), ex("region/2"))
    # inverse links make nations subjects of customer links too: leave those out
    d = op.describe(g.filter(F.col("p") != EX + "hasCustomer"), of_asia)
    return d.select("s", "p", F.col("o")["value"].alias("o"))


# ---------------------------------------------------------------- joins
STAR_SQL = f"""SELECT {CUST} AS c, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
    'mailto:c' || c_custkey || '@example.org' AS mbox FROM customer"""
STAR = {"name": EX + "name", "balance": EX + "balance", "segment": EX + "segment", "mbox": EX + "mbox"}


def _star(b):
    return b.select(value_of("c"), value_of("name"), fn.number(F.col("balance"), "double").alias("balance"),
                    value_of("segment"), value_of("mbox"))


@query("star_one_pass", STAR_SQL)
def star_one_pass(spark, sf):
    g = graph(spark, sf, [TRADE], "customer", "supplier")
    return _star(op.star(g, STAR, EX + "Customer", "c", functional=tuple(STAR)))


@query("star_joins", STAR_SQL)
def star_joins(spark, sf):
    return _star(op.star(graph(spark, sf, [TRADE], "customer", "supplier"), STAR, EX + "Customer", "c"))


@query("star_multi_valued", f"""
    SELECT s_name AS name, {iri('part', 'l_partkey')} AS part FROM supplier
    JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey""")
def star_multi_valued(spark, sf):
    g = one_graph(spark, sf, "supplier", "lineitem")
    b = op.star(g, {"name": EX + "name", "part": EX + "supplies"}, EX + "Supplier", functional=("name",))
    return values(b, "name", "part")


@query("chain_customer_region", """
    SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def chain_customer_region(spark, sf):
    g = one_graph(spark, sf, "customer", "nation", "region")
    b = op.bgp(g, [
        (V("c"), A, ex("Customer")), (V("c"), ex("name"), V("customer")), (V("c"), ex("nation"), V("n")),
        (V("n"), Iri(LABEL), V("nation")), (V("n"), ex("region"), V("r")), (V("r"), Iri(LABEL), V("region"))])
    return values(b, "customer", "nation", "region")


@query("chain_ordered_by_counts", """
    SELECT o_orderstatus AS status, c_name AS customer, n_name AS nation FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def chain_ordered_by_counts(spark, sf):
    g = one_graph(spark, sf, "orders", "customer", "nation")
    chain = [(V("o"), ex("status"), V("status")), (V("o"), ex("customer"), V("c")),
             (V("c"), ex("name"), V("customer")), (V("c"), ex("nation"), V("n")),
             (V("n"), Iri(LABEL), V("nation")), (V("n"), ex("region"), ex("region/1"))]
    b = op.bgp(g, chain, op.pattern_counts(g, chain))
    return values(b, "status", "customer", "nation")


@query("inverse_members", f"""
    SELECT n_name AS nation, c_name AS member FROM nation JOIN customer ON c_nationkey = n_nationkey
    WHERE c_acctbal >= 0""")
def inverse_members(spark, sf):
    g = one_graph(spark, sf, "customer", "nation")
    b = op.bgp(g, [(V("n"), A, ex("Nation")), (V("n"), Iri(LABEL), V("nation")),
                   (V("n"), ex("hasCustomer"), V("c")), (V("c"), A, ex("Customer")), (V("c"), ex("name"), V("member"))])
    return values(b, "nation", "member")


@query("join_partly_unbound", f"""
    WITH l AS (SELECT {DOC} AS doc, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)),
         r AS (SELECT {DOC} AS doc, CASE WHEN l.toxic = 1 THEN l.quality END AS q, d.source
               FROM documents d JOIN labels l USING (doc_id))
    SELECT l.doc, CAST(coalesce(l.q, r.q) AS VARCHAR) AS q, r.source FROM l JOIN r ON l.doc = r.doc
      AND (l.q IS NULL OR r.q IS NULL OR l.q = r.q)""")
def join_partly_unbound(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    docs = op.instances(g, EX + "Document", "doc")
    left = op.optional(docs, op.pattern(g, V("doc"), ex("quality"), V("q")))
    right = op.optional(op.bgp(g, [(V("doc"), ex("toxic"), V("t")), (V("doc"), ex("source"), V("source"))]),
                        op.pattern(g, V("doc"), ex("quality"), V("q")), fn.eq(F.col("t"), 1))
    return values(op.compatible_join(left, right), "doc", "q", "source")


@query("mutual_pairs", f"""
    WITH {KNOWS_SQL} SELECT {iri('user', 'x.a')} AS a, {iri('user', 'x.b')} AS b FROM knows x
    JOIN knows y ON x.a = y.b AND x.b = y.a WHERE {iri('user', 'x.a')} < {iri('user', 'x.b')}""")
def mutual_pairs(spark, sf):
    return values(op.mutual_pairs(one_graph(spark, sf, "events"), EX + "knows"))


OPTIONAL_SQL = f"""SELECT {DOC} AS doc, CAST(l.quality AS VARCHAR) AS quality
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


@query("optional_quality", OPTIONAL_SQL)
def optional_quality(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    b = op.optional(op.instances(g, EX + "Document", "doc"), op.pattern(g, V("doc"), ex("quality"), V("quality")))
    return values(b)


@query("optional_with_filter", OPTIONAL_SQL + " AND l.quality = 1")
def optional_with_filter(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    b = op.optional(op.instances(g, EX + "Document", "doc"), op.pattern(g, V("doc"), ex("quality"), V("quality")),
                    fn.eq(F.col("quality"), 1))
    return values(b)


@query("optional_outer_join", f"""
    SELECT s_name AS name, {iri('part', 'l_partkey')} AS part FROM supplier
    LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey""")
def optional_outer_join(spark, sf):
    g = one_graph(spark, sf, "supplier", "lineitem")
    b = op.optional(op.pattern(g, V("s"), ex("name"), V("name")), op.pattern(g, V("s"), ex("supplies"), V("part")),
                    skew_safe=False)
    return values(b, "name", "part")


@query("union_agents", f"""
    SELECT {CUST} AS agent, c_name AS name, CAST(NULL AS VARCHAR) AS supplier FROM customer
    UNION ALL SELECT {SUPP}, s_name, s_name FROM supplier""")
def union_agents(spark, sf):
    g = one_graph(spark, sf, "customer", "supplier")
    c = op.bgp(g, [(V("agent"), A, ex("Customer")), (V("agent"), ex("name"), V("name"))])
    s = op.bgp(g, [(V("agent"), A, ex("Supplier")), (V("agent"), ex("name"), V("name"))])
    return values(op.union(c, op.extend(s, "supplier", F.col("name"))))


@query("minus_labelled", f"SELECT {DOC} AS doc FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def minus_labelled(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    return values(op.minus(op.instances(g, EX + "Document", "doc"), op.pattern(g, V("doc"), ex("quality"), V("q"))))


@query("minus_partly_unbound", f"""
    SELECT {DOC} AS doc, CAST(l.quality AS VARCHAR) AS q FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM labels m WHERE m.doc_id = d.doc_id AND m.toxic = 1
                      AND (l.quality IS NULL OR l.quality = m.quality))""")
def minus_partly_unbound(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    left = op.optional(op.instances(g, EX + "Document", "doc"), op.pattern(g, V("doc"), ex("quality"), V("q")))
    right = op.bgp(g, [(V("doc"), ex("toxic"), Lit("1", XSD_INTEGER)), (V("doc"), ex("quality"), V("q"))])
    return values(op.minus(left, right))


@query("exists_order", f"SELECT {CUST} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def exists_order(spark, sf):
    g = one_graph(spark, sf, "customer", "orders")
    late = op.bgp(g, [(V("o"), ex("customer"), V("c")), (V("o"), ex("status"), Lit("F"))])
    return values(op.exists(op.instances(g, EX + "Customer", "c"), late))


@query("not_exists_order", f"SELECT {CUST} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_exists_order(spark, sf):
    g = one_graph(spark, sf, "customer", "orders")
    return values(op.exists(op.instances(g, EX + "Customer", "c"),
                            op.pattern(g, V("o"), ex("customer"), V("c")), negate=True))


@query("exists_with_condition", f"""
    SELECT {CUST} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
      AND o_totalprice > c_acctbal * 40)""")
def exists_with_condition(spark, sf):
    g = one_graph(spark, sf, "customer", "orders")
    left = op.pattern(g, V("c"), ex("balance"), V("balance"))
    right = op.bgp(g, [(V("o"), ex("customer"), V("c")), (V("o"), ex("total"), V("total"))])
    enough = fn.gt(F.col("total"), fn.multiply(F.col("balance"), 40.0))
    return values(op.exists(left, right, condition=enough), "c")


@query("subselect_top_nations", """
    WITH top AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 
                 'nation/' || c_nationkey LIMIT 3)
    SELECT c_name AS name, n FROM customer JOIN top USING (c_nationkey)""")
def subselect_top_nations(spark, sf):
    g = one_graph(spark, sf, "customer")
    nations = op.pattern(g, V("c"), ex("nation"), V("nation"))
    top = op.top_k(op.group(nations, ["nation"], n=op.count("c")), [op.desc("n"), "nation"], 3)
    names = op.bgp(g, [(V("c"), ex("nation"), V("nation")), (V("c"), ex("name"), V("name"))])
    return op.compatible_join(names, top, bound=("nation",)).select(value_of("name"), "n")


@query("product_with_total", f"""
    SELECT r_name AS region, (SELECT count(*) FROM nation) AS nations FROM region""")
def product_with_total(spark, sf):
    g = one_graph(spark, sf, "region", "nation")
    labels = op.bgp(g, [(V("r"), A, ex("Region")), (V("r"), Iri(LABEL), V("region"))])
    total = op.group(op.instances(g, EX + "Nation", "n"), [], nations=op.count("n"))
    return op.product(labels, total, max_rows=1).select(value_of("region"), "nations")


@query("reduced_join", """
    SELECT o_orderpriority AS priority, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_acctbal > 9000""")
def reduced_join(spark, sf):
    g = one_graph(spark, sf, "customer", "orders")
    rich = op.where(op.pattern(g, V("c"), ex("balance"), V("b")), fn.gt(F.col("b"), 9000))
    orders = op.bgp(g, [(V("o"), ex("customer"), V("c")), (V("o"), ex("priority"), V("priority"))])
    named = op.reduce_by(op.pattern(g, V("c"), ex("name"), V("name")), rich, ["c"])
    return values(op.reduce_by(orders, rich, ["c"]).join(named, "c"), "priority", "name")


# ---------------------------------------------------------------- paths
@query("path_sequence", f"""
    SELECT {ORD} AS s, {iri('region', 'n_regionkey')} AS o FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""")
def path_sequence(spark, sf):
    g = one_graph(spark, sf, "orders", "customer", "nation")
    return values(op.path_seq(g, [EX + "customer", EX + "nation", EX + "region"]))


@query("path_alternative", f"SELECT {CUST} AS s, c_name AS o FROM customer UNION ALL SELECT {CUST}, c_mktsegment FROM customer")
def path_alternative(spark, sf):
    return values(op.path_alt(one_graph(spark, sf, "customer"), [EX + "name", EX + "segment"]))


@query("path_inverse", f"""
    SELECT {iri('region', 'n_regionkey')} AS s, {CUST} AS o FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def path_inverse(spark, sf):
    g = one_graph(spark, sf, "customer", "nation")
    return values(op.path_seq(g, [path_inv(path_step(g, EX + "region")), path_inv(path_step(g, EX + "nation"))]))


@query("path_negated", f"""
    SELECT {CUST} AS s, c_name AS o FROM customer UNION ALL SELECT {CUST}, c_mktsegment FROM customer
    UNION ALL SELECT {CUST}, 'mailto:c' || c_custkey || '@example.org' FROM customer""")
def path_negated(spark, sf):
    g = one_graph(spark, sf, "customer")
    return values(op.path_neg(g, [RDF_TYPE, EX + "nation", EX + "balance", EX + "hasCustomer"]))


@query("closure_one_or_more", """
    WITH RECURSIVE up(s, o) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0
      UNION SELECT up.s, up.o // 2 FROM up WHERE up.o > 0)
    SELECT '""" + EX + """part/' || s AS s, '""" + EX + """part/' || o AS o FROM up""")
def closure_one_or_more(spark, sf):
    return values(op.path_closure(one_graph(spark, sf, "part"), EX + "broader"))


@query("closure_zero_or_more_from", f"""
    WITH RECURSIVE up(s, o) AS (SELECT p_partkey, p_partkey FROM part WHERE p_brand = 'Brand#1'
      UNION SELECT up.s, up.o // 2 FROM up WHERE up.o > 0)
    SELECT '{EX}part/' || s AS s, '{EX}part/' || o AS o FROM up""")
def closure_zero_or_more_from(spark, sf):
    g = one_graph(spark, sf, "part")
    start = op.pattern(g, V("s"), ex("brand"), Lit("Brand#1"))
    return values(op.path_closure(g, EX + "broader", min_steps=0, start=start))


@query("closure_of_cycles", f"""
    WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 2 AS o FROM part WHERE p_partkey > 0
      UNION SELECT p_partkey // 4, p_partkey FROM part WHERE p_partkey % 16 = 1 AND p_partkey > 4
      UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 5 = 3),
    r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s)
    SELECT '{EX}part/' || s AS s, '{EX}part/' || o AS o FROM r""")
def closure_of_cycles(spark, sf):
    """The part hierarchy with links back to parts two levels below, and links to themselves."""
    key = C("p_partkey")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")

    def links(df, s, o):
        return df.select(iri_term(entity("part", s)).alias("s"), iri_term(entity("part", o)).alias("o"))
    edges = links(p.filter(key > 0), key, F.floor(key / 2)).unionByName(
        links(p.filter((key % 16 == 1) & (key > 4)), F.floor(key / 4), key)).unionByName(
        links(p.filter(key % 5 == 3), key, key))
    return values(op.path_closure(one_graph(spark, sf, "part"), edges))


@query("closure_cyclic", f"""
    WITH RECURSIVE {KNOWS_SQL.replace('knows AS', 'knows(a, b) AS')},
      hop(s, o) AS (SELECT a, b FROM knows UNION SELECT h.s, k.b FROM hop h JOIN knows k ON h.o = k.a)
    SELECT {iri('user', 's')} AS s, {iri('user', 'o')} AS o FROM hop""")
def closure_cyclic(spark, sf):
    return values(op.path_closure(one_graph(spark, sf, "events"), EX + "knows"))


@query("zero_or_one_step", f"""
    SELECT s, o FROM (SELECT {PART} AS s, {PART} AS o FROM part
      UNION SELECT {PART}, {iri('part', 'p_partkey // 2')} FROM part WHERE p_partkey > 0)""")
def zero_or_one_step(spark, sf):
    g = one_graph(spark, sf, "part")
    start = op.instances(g, EX + "Part", "s")
    return values(op.path_closure(g, EX + "broader", min_steps=0, start=start, max_steps=1))


# ---------------------------------------------------------------- cyclic patterns
def lineitem_links(spark, sf):
    """Orders, parts and suppliers linked where a line item names both."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    order, part, supplier = entity("order", C("l_orderkey")), entity("part", C("l_partkey")), entity("supplier", C("l_suppkey"))
    out = l.select(order.alias("a"), part.alias("b"))
    return out.unionByName(l.select(part.alias("a"), supplier.alias("b"))).unionByName(
        l.select(supplier.alias("a"), order.alias("b")))


@query("triangles_of_orders", f"""
    SELECT DISTINCT {iri('order', 'x.l_orderkey')} AS a, {iri('part', 'x.l_partkey')} AS b, {iri('supplier', 'y.l_suppkey')} AS c
    FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN lineitem z ON z.l_partkey = x.l_partkey AND z.l_suppkey = y.l_suppkey""")
def triangles_of_orders(spark, sf):
    """An order, a part in it and a supplier in it who supplies that part (to any order)."""
    return op.triangles(lineitem_links(spark, sf))


@query("squares_of_parts", """
    WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
    n AS (SELECT x.s AS s1, y.s AS s2, count(*) AS n FROM l x JOIN l y ON x.p = y.p AND x.s < y.s GROUP BY ALL)
    SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS squares FROM n""")
def squares_of_parts(spark, sf):
    """How often two suppliers share two parts."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    pairs = op.squares(l.select(entity("part", C("l_partkey")).alias("a"), entity("supplier", C("l_suppkey")).alias("b")))
    n = C("between")
    return pairs.agg(F.sum((n * (n - 1) / 2).cast("long")).alias("squares"))
