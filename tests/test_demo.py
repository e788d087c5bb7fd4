"""A small hand-made graph of people and projects, read from Turtle, with worked answers."""

import pytest
from pyspark.sql import functions as F

from quadloom import operators as op
from quadloom.plans import model, quality
from quadloom.plans.quality import Rule, Shape
from quadloom.sources import catalog, identity, store
from quadloom.terms import RDF_TYPE, XSD_STRING, Iri, Var, value_of, values

NS = "http://example.org/team/"
FOAF = "http://xmlns.com/foaf/0.1/"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
G = "http://example.org/graph/team"
TTL = f"""@prefix t: <{NS}> .
@prefix foaf: <{FOAF}> .
@prefix rdfs: <{RDFS}> .

t:Member a rdfs:Class ; rdfs:label "Member"@en .
t:Study a rdfs:Class ; rdfs:label "Study"@en .

t:dana a t:Member, foaf:Person ;
  foaf:name "Dana" ; foaf:mbox <mailto:dana@example.org> ;
  t:knows t:eli ; t:worksOn t:river .
t:eli a t:Member, foaf:Person ;
  foaf:name "Eli" ; foaf:mbox <mailto:eli@example.org> ;
  t:knows t:dana, t:fay ; t:worksOn t:river .
t:fay a t:Member, foaf:Person ;
  foaf:name "Fay" ; foaf:mbox <mailto:fay@example.org> ;
  t:knows t:dana ; t:worksOn t:river, t:garden .

t:river a t:Study ; rdfs:label "River Study"@en ;
  t:about "Water levels, a sample of Demo data."@en ;
  t:staff t:dana, t:eli, t:fay .
t:garden a t:Study ; rdfs:label "Garden Study"@en ;
  t:about "Plants in a demonstration garden."@en ;
  t:staff t:fay .
"""
PREFIXES = {"t": f"<{NS}>", "foaf:": FOAF, "rdfs": f"<{RDFS}>"}
MODEL = [
    {"Member t:dana": [
        {"a": "t:Member, foaf:Person"}, {"foaf:name": [{"name": '"Dana"'}]},
        {"foaf:mbox": [{"mail": "<mailto:dana@example.org>"}]}, {"t:worksOn+": [{"study": "Study"}]}]},
    {"Study t:river": [
        {"a": "t:Study"}, {"rdfs:label": [{"title": '"River Study"@en'}]},
        {"t:about": [{"about": '"Water"@en'}]}, {"t:staff*": [{"person": "Member"}]}]},
]
SPEC = model.flatten_model(MODEL, PREFIXES, "Team")
V = Var


def t(name):
    return Iri(NS + name)


A, NAME, TITLE = Iri(RDF_TYPE), Iri(FOAF + "name"), Iri(RDFS + "label")


@pytest.fixture(scope="module")
def quads(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    (root / "team.ttl").write_text(TTL)
    sources = catalog.checked_sources(catalog.source_catalog(spark, [{"path": "./team.ttl", "graph": G}]))
    manifest = identity.build_manifest(catalog.discover_files(spark, sources, str(root)), sources)
    assert store.load_quads(spark, manifest, str(root / "store")) == "build"
    assert store.load_quads(spark, manifest, str(root / "store")) == "keep"
    return store.read_store(spark, str(root / "store")).cache()


@pytest.fixture(scope="module")
def graph(quads):
    return op.from_graphs(quads, [G])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts(quads, graph):
    assert rows(op.triple_count(quads)) == [(34,)]
    counts = {r["class_iri"]: r["entities"] for r in quality.class_counts(graph).collect()}
    assert counts == {RDFS + "Class": 2, NS + "Member": 3, FOAF + "Person": 3, NS + "Study": 2}
    links = {r["p"]: r["triples"] for r in quality.predicate_counts(graph).collect()}
    assert [links[NS + p] for p in ("knows", "worksOn", "staff")] == [4, 4, 4]


def test_people(graph):
    b = op.bgp(graph, [(V("m"), A, t("Member")), (V("m"), NAME, V("name"))])
    assert rows(values(op.top_k(b, ["name"], 20), "name")) == [("Dana",), ("Eli",), ("Fay",)]


def test_studies(graph):
    b = op.star(graph, {"label": TITLE.value, "about": NS + "about"}, NS + "Study")
    assert rows(values(op.top_k(b, ["label"], 20), "label")) == [("Garden Study",), ("River Study",)]


def test_memberships(graph):
    b = op.bgp(graph, [(V("m"), A, t("Member")), (V("m"), NAME, V("name")), (V("m"), t("worksOn"), V("s")),
                       (V("s"), A, t("Study")), (V("s"), TITLE, V("label"))])
    assert rows(values(op.top_k(b, ["name", "label"], 50), "name", "label")) == [
        ("Dana", "River Study"), ("Eli", "River Study"), ("Fay", "Garden Study"), ("Fay", "River Study")]


def test_staff(graph):
    b = op.bgp(graph, [(V("s"), A, t("Study")), (V("s"), TITLE, V("label")), (V("s"), t("staff"), V("m")),
                       (V("m"), A, t("Member")), (V("m"), NAME, V("name"))])
    assert rows(values(op.top_k(b, ["label", "name"], 50), "label", "name")) == [
        ("Garden Study", "Fay"), ("River Study", "Dana"), ("River Study", "Eli"), ("River Study", "Fay")]


def test_mutual_pairs(graph):
    pairs = op.mutual_pairs(graph, NS + "knows")
    names = op.pattern(graph, V("a"), NAME, V("name1")), op.pattern(graph, V("b"), NAME, V("name2"))
    assert rows(values(pairs.join(names[0], "a").join(names[1], "b"), "name1", "name2")) == [("Dana", "Eli")]


def test_keyword(graph):
    b = op.star(graph, {"label": TITLE.value, "about": NS + "about"}, NS + "Study")
    found = op.top_k(op.keyword_filter(b, "about", "DEMO"), ["label"], 20)
    assert rows(values(found, "label")) == [("Garden Study",), ("River Study",)]


def test_member_counts(graph):
    b = op.bgp(graph, [(V("s"), A, t("Study")), (V("s"), TITLE, V("label")), (V("s"), t("staff"), V("m"))])
    g = op.group(b, ["label"], n=op.count_distinct("m"))
    assert rows(op.top_k(g, [op.desc("n"), "label"], 20).select(value_of("label"), "n")) == [
        ("River Study", 3), ("Garden Study", 1)]


def test_default_dataset(quads):
    assert op.dataset(quads, "union").count() == 34
    assert op.dataset(quads, "unnamed").count() == 0


def test_table_catalog(spark):
    named = {"Team": {"member list": {}, "study list": {}, "": {}, "databaseinfo__all_attributes": {}, "study__TITLE": {}}}
    got = {r["name"] for r in model.query_catalog(spark, SPEC, named).collect()}
    assert got == {"team__member_list", "team__study_list", "team__member__mail", "team__member__name",
                   "team__member__study", "team__study__about", "team__study__person", "team__study__title"}


def test_facts_are_the_union_of_attribute_tables(graph):
    long = rows(model.attribute_facts(graph, SPEC).select("subject", "attribute", value_of("entity"), value_of("value")))
    single = []
    for a in SPEC:
        df = model.attribute_table(graph, SPEC, a.subject, a.attribute)
        single += [(a.subject, a.attribute, *r) for r in rows(values(df))]
    assert sorted(long) == sorted(single) and len(long) == 3 + 3 + 4 + 2 + 2 + 4


def test_entity_table_with_parameters(graph):
    cols = ["Member", "name", "study", "Study", "title"]
    table = model.entity_table(graph, SPEC, cols)
    assert table.columns == cols and table.count() == 4
    one = model.entity_table(graph, SPEC, cols, {"Member": [NS + "fay"], "name": ""})
    assert sorted(r[4]["value"] for r in one.collect()) == ["Garden Study", "River Study"]
    assert model.default_parameters({"Member": "x"}) == {"Member": "x"}
    assert model.default_parameters(["Member"]) == {"Member": ""}
    assert model.default_parameters(None) == {}


def test_documents(graph):
    docs = {r["doc"]["title"][0]: r["doc"] for r in model.documents(graph, SPEC, "Study", depth=2).collect()}
    river = docs["River Study"]
    assert [p["document"]["name"][0] for p in river["person"]] == ["Dana", "Eli", "Fay"]
    assert river["person"][2]["document"]["study"][0]["document"]["title"] == ["Garden Study"]


def test_shapes(graph):
    shapes = [
        Shape("MemberShape", NS + "Member", (
            Rule(RDF_TYPE, "set", members=(NS + "Member", FOAF + "Person"), at_most=2),
            Rule(FOAF + "name", "literal", XSD_STRING), Rule(FOAF + "mbox", "iri"),
            Rule(NS + "knows", "shape", ref="MemberShape", at_least=0, at_most=None),
            Rule(NS + "worksOn", "shape", ref="StudyShape", at_most=None))),
        Shape("StudyShape", NS + "Study", (
            Rule(RDF_TYPE, "set", members=(NS + "Study",)), Rule(RDFS + "label", "literal", XSD_STRING),
            Rule(NS + "about", "literal", XSD_STRING),
            Rule(NS + "staff", "shape", ref="MemberShape", at_most=None))),
    ]
    strict = rows(quality.validate_shapes(graph, shapes).groupBy("predicate", "problem").count())
    assert sorted(strict) == sorted([(RDFS + "label", "wrong kind of value", 2), (NS + "about", "wrong kind of value", 2)])
    assert quality.validate_shapes(graph, shapes, strict_datatype=False).isEmpty()


def test_links(graph):
    assert quality.inverse_violations(graph, NS + "worksOn", NS + "staff").isEmpty()
    # fay knows dana and eli knows fay, neither back
    assert sorted(rows(values(quality.one_way_links(graph, NS + "knows")))) == [
        (NS + "eli", NS + "fay"), (NS + "fay", NS + "dana")]
    assert quality.dangling_refs(graph, SPEC).isEmpty()
    assert rows(quality.class_pairs(graph)) == [(f"{NS}Member {FOAF}Person", 3)]


def test_counts_feed_functional_star(graph):
    counts = quality.predicate_counts(graph)
    functional = {r["p"] for r in counts.filter(F.col("triples") == F.col("subjects")).collect()}
    assert FOAF + "name" in functional and NS + "staff" not in functional
    with pytest.raises(Exception, match="several values"):
        op.star(graph, {"n": TITLE.value, "m": NS + "staff"}, functional=("n", "m")).collect()


def test_nested_documents_in_parts(spark, tmp_path, monkeypatch):
    """A nation whose customers fill several documents is still one row with all of them."""
    from functools import partial

    from workload import tables
    spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    spark.createDataFrame([(1, "ONE", 0), (2, "TWO", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(
        str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(i, f"C{i:03d}", 1, 1.0, "X") for i in range(100)], (
        "c_custkey int, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")).write.parquet(
        str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(tables.model, "documents", partial(tables.model.documents, part_size=10))
    got = {tuple(r) for r in tables.nested_documents(spark, str(tmp_path)).collect()}
    assert got == {("ONE", "AFRICA", 100, "|".join(f"C{i:03d}" for i in range(100))), ("TWO", "AFRICA", 0, "")}
