"""Model-driven tables, layers, statistics and checks."""

from pyspark.sql import functions as F

from quadloom import functions as fn
from quadloom import operators as op
from quadloom.fixtures import COMMENT, EX, LABEL, PREFIXES
from quadloom.plans import layers, model, quality
from quadloom.plans.quality import Rule, Shape
from quadloom.terms import RDF_TYPE, XSD_DOUBLE, XSD_STRING, Iri, Var, value_of, values

from .graph import KNOWS_SQL, ex
from .registry import CUST, DOC, NAT, PART, REG, SUPP, iri, one_graph, query

V, C = Var, F.col

MODEL = [
    {"Customer ex:customer/1": [
        {"a": ["ex:Customer", "zz:Unknown"]},
        {"ex:name": [{"customer_name": '"Customer#1"'}]},
        {"ex:balance?": [{"balance": "1.0"}]},
        {"ex:segment": [{"segment": '"BUILDING"'}]},
        {"ex:nation": [{"nation": "Nation"}, {"[]": [{"ex:region": [{"home_region": "Region"}]}]}]},
    ]},
    {"Supplier ex:supplier/1": [
        {"a": "ex:Supplier"},
        {"ex:name": [{"supplier_name": '"Supplier#1"'}]},
        {"ex:supplies*": [{"part": "Part"}]},
    ]},
    {"Nation ex:nation/1": [
        {"a": "ex:Nation"},
        {"rdfs:label": [{"nation_label": '"NATION_1"@en'}]},
        {"ex:region": [{"region": "Region"}]},
        {"ex:hasCustomer{0,}": [{"customer": "Customer"}]},
    ]},
    {"Region ex:region/1": [{"a": "ex:Region"}, {"rdfs:label": [{"region_label": '"AFRICA"@en'}]}]},
    {"Part ex:part/1": [
        {"a": "ex:Part"},
        {"ex:brand": [{"kind": '"Brand#1"'}]},
        {"ex:type": [{"kind": '"SMALL"'}]},
    ]},
]
SPEC = model.flatten_model(MODEL, PREFIXES, "trade")
CUSTOMER = [a for a in SPEC if a.subject == "Customer"]


# ---------------------------------------------------------------- tables of the model
@query("class_table", f"SELECT {SUPP} AS entity FROM supplier")
def class_table(spark, sf):
    return values(model.class_table(one_graph(spark, sf, "customer", "supplier"), SPEC, "Supplier"))


@query("attribute_table", f"SELECT {SUPP} AS entity, s_name AS value FROM supplier")
def attribute_table(spark, sf):
    # customers have names too, but not the class
    return values(model.attribute_table(one_graph(spark, sf, "customer", "supplier"), SPEC, "Supplier", "supplier_name"))


@query("attribute_table_two_steps", f"""
    SELECT {CUST} AS entity, {iri('region', 'n_regionkey')} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def attribute_table_two_steps(spark, sf):
    g = one_graph(spark, sf, "customer", "supplier", "nation")
    return values(model.attribute_table(g, SPEC, "Customer", "home_region"))


@query("attribute_table_alternatives", f"SELECT {PART} AS entity, p_brand AS value FROM part UNION ALL SELECT {PART}, p_type FROM part")
def attribute_table_alternatives(spark, sf):
    return values(model.attribute_table(one_graph(spark, sf, "part"), SPEC, "Part", "kind"))


FACTS_SQL = f"""
    WITH c AS (SELECT *, {CUST} AS e FROM customer), n AS (SELECT *, {NAT} AS e FROM nation)
    SELECT 'Customer' AS subject, 'customer_name' AS attribute, e AS entity, c_name AS value FROM c
    UNION ALL SELECT 'Customer', 'balance', e, CAST(c_acctbal AS VARCHAR) FROM c
    UNION ALL SELECT 'Customer', 'segment', e, c_mktsegment FROM c
    UNION ALL SELECT 'Customer', 'nation', e, {iri('nation', 'c_nationkey')} FROM c
    UNION ALL SELECT 'Customer', 'home_region', c.e, {iri('region', 'n_regionkey')} FROM c JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'Nation', 'nation_label', e, n_name FROM n
    UNION ALL SELECT 'Nation', 'region', e, {iri('region', 'n_regionkey')} FROM n
    UNION ALL SELECT 'Nation', 'customer', {iri('nation', 'c_nationkey')}, e FROM c WHERE c_acctbal >= 0
    UNION ALL SELECT 'Region', 'region_label', {REG}, r_name FROM region
    UNION ALL SELECT 'Supplier', 'supplier_name', {SUPP}, s_name FROM supplier
    UNION ALL SELECT 'Supplier', 'part', {iri('supplier', 'l_suppkey')}, {iri('part', 'l_partkey')}
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    UNION ALL SELECT 'Part', 'kind', {PART}, p_brand FROM part UNION ALL SELECT 'Part', 'kind', {PART}, p_type FROM part"""


@query("attribute_facts", FACTS_SQL)
def attribute_facts(spark, sf):
    g = one_graph(spark, sf, "customer", "supplier", "nation", "region", "part", "lineitem")
    return model.attribute_facts(g, SPEC).select("subject", "attribute", value_of("entity"), value_of("value"))


@query("entity_table", """
    SELECT c_name AS customer_name, c_mktsegment AS segment, n_name AS nation_label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def entity_table(spark, sf):
    g = one_graph(spark, sf, "customer", "nation", "supplier")
    t = model.entity_table(g, SPEC, ["Customer", "customer_name", "segment", "Nation", "nation_label"],
                           functional=("customer_name", "segment"))
    return values(t, "customer_name", "segment", "nation_label")


@query("entity_table_one_entity", f"""
    SELECT {CUST} AS "Customer", c_name AS customer_name, {iri('region', 'n_regionkey')} AS home_region
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (7, 11)""")
def entity_table_one_entity(spark, sf):
    g = one_graph(spark, sf, "customer", "nation")
    params = {**model.default_parameters(["segment"]), "Customer": [EX + "customer/7", EX + "customer/11"]}
    return values(model.entity_table(g, SPEC, ["Customer", "customer_name", "home_region"], params))


@query("nested_documents", """
    SELECT n_name AS label, r_name AS region, count(c_custkey) AS customers,
      coalesce(string_agg(c_name, '|' ORDER BY c_name), '') AS names
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 0
    GROUP BY n_nationkey, n_name, r_name""")
def nested_documents(spark, sf):
    g = one_graph(spark, sf, "nation", "region", "customer")
    d = model.documents(g, SPEC, "Nation", depth=1)
    # a nation of many customers is a document in parts; the label and the region may stand in any of them
    names = F.flatten(F.flatten(F.collect_list(F.transform("doc.customer", lambda x: x["document"]["customer_name"]))))
    region = F.get(F.get("doc.region", F.lit(0))["document"]["region_label"], F.lit(0))
    return d.groupBy("entity").agg(
        F.min(F.get("doc.nation_label", F.lit(0))).alias("label"), F.min(region).alias("region"),
        F.sum(F.size("doc.customer")).alias("customers"), F.array_join(F.array_sort(names), "|").alias("names")).drop("entity")


@query("documents_in_parts", f"""
    SELECT {SUPP} AS supplier, count(DISTINCT l_partkey) AS parts, true AS whole FROM supplier
    LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def documents_in_parts(spark, sf):
    g = one_graph(spark, sf, "supplier", "lineitem")
    spec = [a for a in SPEC if a.subject == "Supplier"]
    d = model.documents(g, spec, "Supplier", depth=0, part_size=100)
    return d.groupBy(C("entity")["value"].alias("supplier")).agg(
        F.sum(F.size("doc.part")).alias("parts"), (F.sum(F.size("doc.supplier_name")) == 1).alias("whole"))


@query("documents_by_iri", f"SELECT '{EX}customer/' || c_custkey AS iri, c_name AS name FROM customer WHERE c_custkey IN (3, 5)")
def documents_by_iri(spark, sf):
    d = model.documents(one_graph(spark, sf, "customer", "nation"), CUSTOMER, "Customer", depth=0,
                        iris=[EX + "customer/3", EX + "customer/5", EX + "customer/none"])
    return d.select(C("doc.iri").alias("iri"), C("doc.customer_name")[0].alias("name"))


@query("two_layers", """
    SELECT r_name AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def two_layers(spark, sf):
    g = one_graph(spark, sf, "customer", "nation", "region")
    layer1 = {
        "Trade  Customers": model.entity_table(g, SPEC, ["Customer", "segment", "nation"], functional=("segment", "nation")),
        "Trade  Nations": model.entity_table(g, SPEC, ["Nation", "region"]),
        "Trade  Regions": model.entity_table(g, SPEC, ["Region", "region_label"]),
    }
    layer2 = {
        "located": "SELECT segment, region FROM trade_customers JOIN trade_nations ON trade_customers.nation = trade_nations.Nation",
        "by region": """SELECT region_label AS region, segment, count(*) AS n FROM located
                        JOIN trade_regions ON located.region = trade_regions.Region GROUP BY region_label, segment""",
    }
    return layers.build_layers(spark, layer1, layer2)["by_region"]


@query("api_count", """SELECT '{"count":' || count(*) || '}' AS json, CAST(count(*) AS VARCHAR) AS text FROM orders""")
def api_count(spark, sf):
    return layers.api_result(op.instances(one_graph(spark, sf, "orders"), EX + "Order"))


# ---------------------------------------------------------------- statistics
@query("class_counts", f"""
    SELECT '{EX}Customer' AS class_iri, count(*) AS entities FROM customer UNION ALL SELECT '{EX}Supplier', count(*) FROM supplier
    UNION ALL SELECT '{EX}Agent', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
    UNION ALL SELECT '{EX}Part', count(*) FROM part UNION ALL SELECT '{EX}Order', count(*) FROM orders""")
def class_counts(spark, sf):
    return quality.class_counts(one_graph(spark, sf, "customer", "supplier", "part", "orders"))


@query("predicate_counts", f"""
    SELECT '{EX}supplies' AS p, count(*) AS triples, count(DISTINCT l_suppkey) AS subjects, count(DISTINCT l_partkey) AS objects
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    UNION ALL SELECT '{EX}brand', count(*), count(*), count(DISTINCT p_brand) FROM part
    UNION ALL SELECT '{EX}type', count(*), count(*), count(DISTINCT p_type) FROM part
    UNION ALL SELECT '{EX}name', count(*), count(*), count(DISTINCT p_name) FROM part
    UNION ALL SELECT '{EX}size', count(*), count(*), count(DISTINCT p_size) FROM part
    UNION ALL SELECT '{EX}broader', count(*), count(*), count(DISTINCT p_partkey // 2) FROM part WHERE p_partkey > 0
    UNION ALL SELECT '{RDF_TYPE}', count(*), count(*), 1 FROM part""")
def predicate_counts(spark, sf):
    return quality.predicate_counts(one_graph(spark, sf, "part", "lineitem"))


@query("class_pairs", f"""
    SELECT '{EX}Agent {EX}Customer' AS classes, count(*) AS entities FROM customer
    UNION ALL SELECT '{EX}Agent {EX}Supplier', count(*) FROM supplier""")
def class_pairs(spark, sf):
    return quality.class_pairs(one_graph(spark, sf, "customer", "supplier", "part"))


# ---------------------------------------------------------------- checks
@query("inverse_violations", f"""
    SELECT {CUST} AS s, {iri('nation', 'c_nationkey')} AS o, '{EX}hasCustomer' AS missing FROM customer WHERE c_acctbal < 0""")
def inverse_violations(spark, sf):
    g = one_graph(spark, sf, "customer")
    return quality.inverse_violations(g, EX + "nation", EX + "hasCustomer").select(value_of("s"), value_of("o"), "missing")


@query("one_way_links", f"""
    WITH {KNOWS_SQL} SELECT {iri('user', 'x.a')} AS s, {iri('user', 'x.b')} AS o FROM knows x WHERE x.a <> x.b
      AND NOT EXISTS (SELECT 1 FROM knows y WHERE y.a = x.b AND y.b = x.a)""")
def one_way_links(spark, sf):
    return values(quality.one_way_links(one_graph(spark, sf, "events"), EX + "knows"))


@query("dangling_references", f"""
    SELECT 'Supplier' AS subject, 'part' AS attribute, {iri('supplier', 'l_suppkey')} AS entity, {iri('part', 'l_partkey')} AS value
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#1')""")
def dangling_references(spark, sf):
    g = one_graph(spark, sf, "supplier", "lineitem", "part")
    brand = op.pattern(g, V("x"), ex("brand"), V("b")).filter(C("b")["value"] == "Brand#1")
    untyped = brand.select(C("x")["value"].alias("s"))
    kept = g.filter(C("p") != RDF_TYPE).unionByName(g.filter(C("p") == RDF_TYPE).join(untyped, "s", "left_anti").select(g.columns))
    spec = [a for a in SPEC if a.subject in ("Supplier", "Part")]
    d = quality.dangling_refs(kept, spec)
    return d.select("subject", "attribute", value_of("entity"), value_of("value"))


SHAPES = [
    Shape("CustomerShape", EX + "Customer", (
        Rule(RDF_TYPE, "set", members=(EX + "Customer", EX + "Agent"), at_most=2),
        Rule(EX + "name", "literal", XSD_STRING),
        Rule(EX + "mbox", "iri"),
        Rule(EX + "balance", "literal", XSD_DOUBLE, at_least=0),
        Rule(EX + "nation", "shape", ref="NationShape"),
    )),
    Shape("NationShape", EX + "Nation", (
        Rule(LABEL, "literal", XSD_STRING),
        Rule(EX + "hasCustomer", "shape", ref="CustomerShape", at_least=1, at_most=None),
    )),
]


@query("shape_violations", f"""
    SELECT 'NationShape' AS shape, {NAT} AS focus, '{LABEL}' AS predicate, 'wrong kind of value' AS problem, 1 AS n FROM nation
    UNION ALL SELECT 'NationShape', {NAT}, '{EX}hasCustomer', 'too few values', 0 FROM nation
      WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal >= 0)""")
def shape_violations(spark, sf):
    found = quality.validate_shapes(one_graph(spark, sf, "customer", "nation"), SHAPES)
    return found.withColumn("focus", C("focus")["value"])


@query("shape_violations_lenient", f"""
    SELECT 'CustomerShape' AS shape, {CUST} AS focus, '{EX}nation' AS predicate, 'value lacks the class of its shape' AS problem, 1 AS n
    FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)
    UNION ALL SELECT 'NationShape', {NAT}, '{EX}hasCustomer', 'too few values', 0 FROM nation WHERE n_regionkey <> 3
      AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal >= 0)""")
def shape_violations_lenient(spark, sf):
    g = one_graph(spark, sf, "customer", "nation")
    lost = op.pattern(g, V("n"), ex("region"), ex("region/3")).select(C("n")["value"].alias("s"))
    typed = C("p") == RDF_TYPE
    g = g.filter(~typed).unionByName(g.filter(typed).join(lost, "s", "left_anti").select(g.columns))
    found = quality.validate_shapes(g, SHAPES, strict_datatype=False)
    return found.withColumn("focus", C("focus")["value"])


@query("keyword_labels_ranked", f"""
    SELECT {DOC} AS doc, l.quality AS quality, length(d.text) AS n FROM documents d JOIN labels l USING (doc_id)
    WHERE contains(lower(d.text), 'the ') ORDER BY n DESC, doc LIMIT 20""")
def keyword_labels_ranked(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    b = op.bgp(g, [(V("doc"), ex("quality"), V("q")), (V("doc"), Iri(COMMENT), V("text"))])
    b = op.keyword_filter(b, "text", "the ").select("doc", "q", fn.strlen(C("text")).alias("n"))
    return op.top_k(b, [op.desc("n"), "doc"], 20).select(value_of("doc"), fn.number(C("q")).alias("quality"), "n")
