"""Catalog, discovery, compression, hashing, readers and the store on hand-written files."""

import bz2
import gzip
import hashlib
import json
import lzma
import os
import re
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from quadloom import operators as op
from quadloom.operators import distinct_quads
from quadloom.plans import quality
from quadloom.sources import catalog, identity, readers, store, writers
from quadloom.sources.turtle import parse_turtle
from quadloom.terms import LANG_STRING, XSD, XSD_STRING, Iri, Var

LINES = r'''<http://x/s> <http://x/p> "a\"b\\n\\\\c\nd\té\U0001F600 \'" .
# comment

<http://x/s> <http://x/p> "text . with dots"@en-GB .
_:b1 <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer>.
<http://x/s> <http://x/p> "" .   # empty
<http://x/s> <http://x/p> _:b1.
'''
EXPECTED = [
    ("http://x/s", (2, 'a"b\\n\\\\c\nd\té😀 \'', "", XSD_STRING)),
    ("http://x/s", (2, "text . with dots", "en-gb", LANG_STRING)),
    ("B1", (2, "5", "", XSD + "integer")),
    ("http://x/s", (2, "", "", XSD_STRING)),
    ("http://x/s", (0, "B1", "", "")),
]


def load(spark, root, entries):
    sources = catalog.checked_sources(catalog.source_catalog(spark, entries))
    return identity.build_manifest(catalog.discover_files(spark, sources, str(root)), sources), sources


def content(quads):
    def fix(x):
        return "B1" if x.endswith("/b1") else x
    return sorted((fix(r["s"]), (r["o"]["kind"], fix(r["o"]["value"]), r["o"]["lang"], r["o"]["dt"]))
                  for r in quads.collect())


# ---------------------------------------------------------------- catalog
def test_catalog_is_strict(spark):
    with pytest.raises(catalog.CatalogError, match="lists no source"):
        catalog.source_catalog(spark, [])
    with pytest.raises(catalog.CatalogError, match="keys not known: color"):
        catalog.source_catalog(spark, [{"path": "x", "color": "red"}])


@pytest.mark.parametrize("entry, message", [
    ({"path": "a.nq", "format": "nq", "graph": "http://g"}, "source #0: nq lines name their own graphs"),
    ({"name": "no path", "format": "ttl"}, "source #0: no path given"),
    ({"path": "a.xml", "format": "xml"}, "source #0: unknown format"),
    ({"format": "xml", "graph": "http://g"}, "source #0: unknown format"),
    ({"format": "nq", "graph": "http://g"}, "name their own graphs"),
])
def test_catalog_errors(spark, entry, message):
    with pytest.raises(catalog.CatalogError, match=message):
        catalog.checked_sources(catalog.source_catalog(spark, [entry]))


def test_default_format(spark, tmp_path):
    (tmp_path / "sources").mkdir()
    (tmp_path / "sources" / "one.ttl").write_text("@prefix ex: <http://example.org/> .\n")
    manifest, _ = load(spark, tmp_path, [{"path": "./sources/one.ttl"}])
    assert [r["format"] for r in manifest.collect()] == ["ttl"]


def test_discovery_order_and_depth(spark, tmp_path):
    for name in ("a/b.nt", "a-b.nt", "a/c/d.nt", "a/c/e/f.nt", "z.nt", "dir.nt/inner.txt", "sp ace+.nt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# nothing\n")
    sources = catalog.source_catalog(spark, [
        {"path": "**/*.nt", "format": "nt"}, {"path": "a/*.nt", "format": "nt"}, {"path": "[az]?*.nt", "format": "nt"}])
    found = catalog.discover_files(spark, sources, str(tmp_path)).orderBy("source_idx", "file_idx").collect()
    names = [(r["source_idx"], r["file_idx"], os.path.relpath(r["path"], tmp_path)) for r in found]
    # folder by folder: "a" sorts before "a-b.nt" although "-" is below "/"
    assert names == [
        (0, 0, "a/b.nt"), (0, 1, "a/c/d.nt"), (0, 2, "a/c/e/f.nt"), (0, 3, "a-b.nt"), (0, 4, "sp ace+.nt"), (0, 5, "z.nt"),
        (1, 0, "a/b.nt"), (2, 0, "a-b.nt")]
    for path, message in (("nothing/*.nt", "nothing exists"), ("*.nq", "nothing exists"), ("dir.*", "no file fits")):
        one = catalog.source_catalog(spark, [{"path": path, "format": "nt"}])
        with pytest.raises(catalog.CatalogError, match=message):
            catalog.discover_files(spark, one, str(tmp_path))
    lines = readers.read_lines(spark, catalog.discover_files(
        spark, catalog.source_catalog(spark, [{"path": "sp*.nt"}]), str(tmp_path)))
    assert lines.count() == 1 and readers.read_ntriples(lines).isEmpty()


def test_staged_names(spark):
    cases = {"/x/data.nt": "source_3_1.ttl", "/x/data.ttl.gz": "source_3_1.ttl", "/x/a.b.ttl": "source_3_1.b.ttl",
             "/x.d/data": "source_3_1.ttl", "/x/a.tar.nt.zstd": "source_3_1.tar.ttl", "/x/a.GZ": "source_3_1.ttl"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r[0]: r[1] for r in df.select("path", catalog.staged_name(F.lit(3), F.lit(1), F.col("path"), F.lit("ttl"))).collect()}
    assert got == cases


# ---------------------------------------------------------------- compression and hashing
WRITERS = {
    "plain.nt": lambda d: d, "one.nt.gz": gzip.compress, "two.nt.gz": lambda d: gzip.compress(d[:40]) + gzip.compress(d[40:]),
    "b.nt.bz2": bz2.compress, "x.nt.xz": lzma.compress, "z.nt.zst": zstandard.compress, "zz.nt.zstd": zstandard.compress,
}


def test_every_compression_reads_and_hashes_alike(spark, tmp_path):
    for name, pack in WRITERS.items():
        (tmp_path / name).write_bytes(pack(LINES.encode()))
    manifest, _ = load(spark, tmp_path, [{"path": "*.nt*", "format": "nt", "graph": "http://g"}])
    assert {r["sha256"] for r in manifest.collect()} == {hashlib.sha256(LINES.encode()).hexdigest()}
    quads = readers.read_quads(spark, manifest)
    assert {r["g"] for r in quads.select("g").distinct().collect()} == {"http://g"}
    for i in range(len(WRITERS)):
        assert content(quads.filter(F.col("file_idx") == i)) == sorted(EXPECTED)
    # one label in two files is two nodes
    assert quads.filter("s_kind = 0").select("s").distinct().count() == len(WRITERS)


def test_input_hash_is_that_of_the_compact_json(spark, tmp_path):
    (tmp_path / 'qu"é.nt').write_text(LINES)
    (tmp_path / "b.nq").write_text("# nothing\n")
    manifest, _ = load(spark, tmp_path, [{"path": "*.nt", "format": "nt", "graph": "http://g"}, {"path": "b.nq", "format": "nq"}])
    rows = [{"path": r["path"], "graph": r["graph"], "format": r["format"], "sha256": r["sha256"]}
            for r in manifest.orderBy("source_idx", "file_idx").collect()]
    text = json.dumps({"sources": rows, "input_hash": ""}, ensure_ascii=False, separators=(",", ":"))
    assert '"graph":null' in text
    assert identity.input_hash(manifest) == hashlib.sha256(text.encode()).hexdigest()
    identity.write_manifest(manifest, str(tmp_path / "manifest"))
    assert identity.input_hash(identity.read_manifest(spark, str(tmp_path / "manifest"))) == identity.input_hash(manifest)


def test_changed_archive_is_hashed_again(spark, tmp_path):
    path = tmp_path / "a.nt.gz"
    path.write_bytes(gzip.compress(b"first\n"))
    entries = [{"path": "a.nt.gz", "format": "nt"}]
    old, sources = load(spark, tmp_path, entries)
    files = catalog.discover_files(spark, sources, str(tmp_path))
    assert identity.changed_files(files, old).isEmpty()
    same = identity.refresh_manifest(files, sources, old).collect()
    assert same[0]["sha256"] == old.first()["sha256"]
    path.write_bytes(gzip.compress(b"second\n"))
    os.utime(path, (time.time() + 5, time.time() + 5))
    files = catalog.discover_files(spark, sources, str(tmp_path))
    new = identity.refresh_manifest(files, sources, old)
    assert new.first()["sha256"] == hashlib.sha256(b"second\n").hexdigest()
    assert [r["change"] for r in identity.manifest_diff(old, new).collect()] == ["changed"]


def test_load_decision():
    assert identity.load_decision(None, "h", False) == "build"
    assert identity.load_decision(None, "h", True) == "reset"
    assert identity.load_decision("h", "h", True) == "keep"
    assert identity.load_decision("g", "h", True) == "reset"


# ---------------------------------------------------------------- line formats
def lines_of(spark, *lines):
    return spark.createDataFrame([(0, 0, l) for l in lines], readers.PARSED)


BAD = ["<s> <p> bad .", '<http://s> <http://p> "open .', "<http://s> <http://p> <http://o>", '"x" <http://p> <http://o> .',
       "<http://s> _:p <http://o> .", '<http://s> <http://p> "x\\q" .', "<http://s> <http://p> <http://o> <http://g> . x"]


@pytest.mark.parametrize("bad", BAD)
def test_bad_lines(spark, bad):
    good = "<http://s> <http://p> <http://o> ."
    df = lines_of(spark, good, bad)
    quads, rejects = readers.read_ntriples(df, mode="quarantine")
    assert quads.count() == 1 and [r["line"] for r in rejects.collect()] == [bad]
    with pytest.raises(Exception, match="cannot parse line"):
        readers.read_ntriples(df).collect()


def test_graph_of_a_line(spark):
    q = readers.read_nquads(lines_of(
        spark, "<http://s> <http://p> <http://o> <http://g> .", "<http://s> <http://p> <http://o> .",
        "<http://s> <http://p> <http://o> _:g ."))
    assert sorted(str(r["g"]) for r in q.collect()) == ["None", "_:0/0/g", "http://g"]
    assert readers.read_ntriples(lines_of(spark, "<http://s> <http://p> <http://o> <http://g> ."), mode="quarantine")[0].isEmpty()


def test_very_long_literal(spark):
    text = "ab\\n" * 200_000
    q = readers.read_ntriples(lines_of(spark, f'<http://s> <http://p> "{text}" .'))
    assert q.select(F.length("o.value")).first()[0] == 600_000


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "a.nt").write_text(LINES)
    manifest, _ = load(spark, tmp_path, [{"path": "a.nt", "format": "nt"}])
    quads = readers.read_quads(spark, manifest)
    writers.write_nquads(quads, str(tmp_path / "out"))
    again, _ = load(spark, tmp_path, [{"path": "out/part-*", "format": "nq"}])
    back = readers.read_quads(spark, again).filter("s_kind = 1 AND o.kind = 2")
    assert content(back) == [r for r in sorted(EXPECTED) if r[0] != "B1" and r[1][0] == 2]


# ---------------------------------------------------------------- Turtle
TURTLE = '''@prefix ex: <http://x/> .
PREFIX foaf: <http://f/>
@base <http://base/dir/> .
ex:a a ex:P , foaf:Q ; foaf:name "A \\"q\\" . x" ; ex:n 5, -2.5, 1e3, true ; ex:d <rel>, <> .
ex:b ex:long """multi
line "quoted" . ex:fake ex:fake ex:fake .
@prefix ex: <http://wrong/> .
# not a comment
end"""@en ; ex:list (1 "two" ex:c) ; ex:anon [ ex:p [ ex:q 'v' ] ; ex:r ex:s ] ; ex:none () .
[] ex:p _:x1 . _:x1 ex:p ex:y.
@prefix ex: <http://y/> .
ex:a ex:p "1"^^<http://dt>, "2"^^ex:dt ; . # comment . here
[ ex:k \'\'\'one
two\'\'\' ] .
ex:last ex:p ex:o\\,x, ex:dots.in.name .
'''


def turtle_rows(frame):
    strip = re.compile(r"\.\d+\.\d+$")
    return sorted((strip.sub(".b", r["s"]), r["p"], r["o"]["kind"], strip.sub(".b", r["o"]["value"]), r["o"]["lang"], r["o"]["dt"])
                  for r in frame.collect())


def turtle_file(spark, path):
    return spark.createDataFrame([(0, 0, str(path), os.path.getsize(path))], "source_idx int, file_idx int, path string, size bigint")


def test_turtle_features(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TURTLE)
    got = parse_turtle(spark, turtle_file(spark, tmp_path / "t.ttl"))
    r = {(x[1], x[3]) for x in turtle_rows(got)}
    for pair in [("http://f/name", 'A "q" . x'), ("http://x/d", "http://base/dir/rel"), ("http://x/d", "http://base/dir/"),
                 ("http://x/n", "-2.5"), ("http://y/p", "http://y/o,x"), ("http://y/p", "http://y/dots.in.name"),
                 ("http://y/k", "one\ntwo"), ("http://x/p", "http://x/y"), ("http://x/none", RDF_NIL)]:
        assert pair in r
    long = got.filter("p = 'http://x/long'").first()["o"]
    assert long["lang"] == "en" and long["value"].count("\n") == 4 and "http" not in {x[1] for x in turtle_rows(got)}
    assert got.count() == 29


RDF_NIL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"


@pytest.mark.parametrize("size", [13, 40, 97, 256])
def test_turtle_ranges_give_the_same_graph(spark, tmp_path, size):
    (tmp_path / "t.ttl").write_text(TURTLE * 2)
    files = turtle_file(spark, tmp_path / "t.ttl")
    assert turtle_rows(parse_turtle(spark, files, range_bytes=size)) == turtle_rows(parse_turtle(spark, files))


def test_turtle_rejects(spark, tmp_path):
    (tmp_path / "t.ttl").write_text("@prefix e: <http://e/> .\ne:a e:b e:c .\ne:a e:b .\nz:a e:b e:c .\ne:x e:y e:z .\n")
    files = turtle_file(spark, tmp_path / "t.ttl")
    good, bad = parse_turtle(spark, files, "quarantine")
    assert good.count() == 2 and bad.count() == 2
    with pytest.raises(Exception, match="cannot parse statement"):
        parse_turtle(spark, files).collect()


@pytest.mark.parametrize("size", [64 << 20, 150])
def test_rejects_name_their_bytes(spark, tmp_path, size):
    text = ("@prefix e: <http://e/> .\n# caf\u00e9 \u20ac\ne:a e:b \"\u00fc\", e:c .\ne:a e:b e:c ; e:d \"\u20ac\u20ac\" , .\n"
            "e:x e:y e:z .\nz:a e:b\n  \"\u00e9\" .\ne:q e:r \"\"\"long\n. text\"\"\" ; ; [] .\ne:x e:y e:last .\n") * 2
    (tmp_path / "t.ttl").write_text(text, encoding="utf-8")
    good, bad = parse_turtle(spark, turtle_file(spark, tmp_path / "t.ttl"), "quarantine", size)
    raw = text.encode()
    rejects = bad.orderBy("start").collect()
    assert [raw[r.start:r.end].decode() for r in rejects] == [r.line for r in rejects]
    assert [r.line for r in rejects][:3] == ['e:a e:b e:c ; e:d "\u20ac\u20ac" , .', 'z:a e:b\n  "\u00e9" .',
                                             'e:q e:r """long\n. text""" ; ; [] .'] and len(rejects) == 6
    assert good.count() == 8 and good.distinct().count() == 4


def test_long_faulty_statement_leaves_nothing(spark, tmp_path):
    objects = " , ".join(f"e:o{i}" for i in range(150_000))
    bad_text = f"e:s e:p {objects} , ."
    (tmp_path / "t.ttl").write_text(f"@prefix e: <http://e/> .\ne:a e:b e:c .\n{bad_text}\ne:x e:y e:z .\n")
    good, bad = parse_turtle(spark, turtle_file(spark, tmp_path / "t.ttl"), "quarantine")
    assert sorted(r.s for r in good.collect()) == ["http://e/a", "http://e/x"]
    pieces = bad.orderBy("piece").collect()
    assert len(pieces) == 2 and "".join(r.line for r in pieces) == bad_text


@pytest.mark.parametrize("fmt, name", [("nt", "f.nt"), ("nt", "f.nt.xz"), ("ttl", "f.ttl"), ("ttl", "f.ttl.gz")])
def test_one_file_under_two_sources(spark, tmp_path, fmt, name):
    text = "".join(f"<http://s/{i}> <http://p> _:x .\n" for i in range(5)).encode()
    packed = {"xz": lzma.compress, "gz": gzip.compress}.get(name.rsplit(".", 1)[-1], bytes)
    (tmp_path / name).write_bytes(packed(text))
    manifest, _ = load(spark, tmp_path, [{"path": name, "format": fmt, "graph": f"http://g/{k}"} for k in (1, 2)])
    got = readers.read_quads(spark, manifest)
    assert sorted((r.g, r.n) for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()) == [
        ("http://g/1", 5), ("http://g/2", 5)]
    assert got.select(F.col("o")["value"]).distinct().count() == 2
    if name == "f.ttl":
        files = manifest.select("source_idx", "file_idx", "path", "size")
        ranged = parse_turtle(spark, files, range_bytes=40)
        assert turtle_rows(ranged) == turtle_rows(got)


def test_ranges_of_a_file_behind_an_arrow_file_system(tmp_path, monkeypatch):
    from pyarrow import fs

    from quadloom.sources import turtle_workers, workers

    (tmp_path / "t.ttl").write_text(TURTLE)
    opened = workers.io.BufferedReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "t.ttl")), 64)
    monkeypatch.setattr(turtle_workers, "open_raw", lambda path: opened)
    text = "".join(t for t, inside in turtle_workers.blocks("any", 60, 200, True) if inside)
    start = TURTLE.index("\n", 59) + 1
    assert TURTLE[start:].startswith(text) and text.endswith("\n") and len(text) >= 140 - 60


def test_packed_turtle(spark, tmp_path):
    (tmp_path / "t.ttl.xz").write_bytes(lzma.compress(TURTLE.encode()))
    (tmp_path / "t.ttl").write_text(TURTLE)
    packed = parse_turtle(spark, turtle_file(spark, tmp_path / "t.ttl.xz"), range_bytes=50)
    assert turtle_rows(packed) == turtle_rows(parse_turtle(spark, turtle_file(spark, tmp_path / "t.ttl")))


# ---------------------------------------------------------------- store
def test_what_a_dead_load_left_is_not_read(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<http://a/1> <http://p> <http://o> .\n")
    manifest, _ = load(spark, tmp_path, [{"path": "a.nt", "format": "nt", "graph": "http://g"}])
    place = str(tmp_path / "store")
    left = tmp_path / "store" / "data" / "0123"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"unfinished")
    assert store.load_quads(spark, manifest, place) == "build"
    assert [r.s for r in store.read_store(spark, place).collect()] == ["http://a/1"]


def quads_of(spark, *rows):
    """Quads from (graph, subject, source) with one predicate and object."""
    text = ["<http://%s> <http://p> <http://o> %s ." % (s, f"<http://{g}>" if g else "") for g, s, _ in rows]
    lines = spark.createDataFrame([(k, 0, t) for t, (_, _, k) in zip(text, rows)], readers.PARSED)
    return readers.read_nquads(lines)


def held(spark, place):
    rows = store.read_owners(spark, place).collect()
    assert len({(r.g, r.s) for r in rows}) == len(rows)
    return {(r.g and r.g[7:], r.s[7:]): r.owners for r in rows}


def test_owner_sets_of_many_sources(spark):
    rows = [("g", "x", k) for k in (0, 5, 61, 62, 130)] + [("g", "y", 61), (None, "y", 62), (None, "y", 62), ("g", "z", None)]
    got = {(r.g, r.s): r.owners for r in store.owned(quads_of(spark, *rows)).collect()}
    assert got == {("http://g", "http://x"): [0, 5, 61, 62, 130], ("http://g", "http://y"): [61],
                   (None, "http://y"): [62], ("http://g", "http://z"): [store.UPDATES]}


def test_updates_are_kept_as_layers(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "store")
    monkeypatch.setattr(store, "MERGE_SHARE", 9)
    store.reload_quads(quads_of(spark, ("g", "a", 0), ("g", "a", 1), ("g", "b", 0), (None, "b", 1)), place, "hash")
    store.apply_update(spark, place, quads_of(spark, ("g", "a", 7), ("g", "none", 7)), quads_of(spark, ("g", "c", 7), ("g", "b", 7)))
    assert held(spark, place) == {("g", "b"): [-1, 0], (None, "b"): [1], ("g", "c"): [-1]}
    store.apply_update(spark, place, quads_of(spark, (None, "b", 0)))
    store.apply_update(spark, place, quads_of(spark, ("g", "a", 0)), quads_of(spark, ("g", "a", 0)))
    want = {("g", "b"): [-1, 0], ("g", "c"): [-1], ("g", "a"): [-1]}
    assert held(spark, place) == want
    load = store.current_load(spark, place)
    assert len(load["layers"]) == 4 and load["rows"] == [3, 3, 1, 1] and load["input_hash"] == "hash"
    assert store.apply_update(spark, place, quads_of(spark, ("g", "none", 0))) == 5
    assert len(store.current_load(spark, place)["layers"]) == 4
    store.compact(spark, place)
    load = store.current_load(spark, place)
    assert held(spark, place) == want and load["rows"] == [3] and load["input_hash"] == "hash"
    assert {r.s[7:]: r.source_idx for r in store.read_store(spark, place).collect()} == {"a": None, "b": None, "c": None}
    monkeypatch.setattr(store, "MERGE_SHARE", 0.1)
    store.apply_update(spark, place, insert=quads_of(spark, ("g", "d", 0)))
    assert len(store.current_load(spark, place)["layers"]) == 1 and len(held(spark, place)) == 4


def test_refresh_leaves_updates_and_other_owners(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MERGE_SHARE", 9)
    line = "<http://{0}> <http://p> <http://o> <http://g> .\n"

    def write(name, subjects):
        (tmp_path / f"{name}.nq").write_text("".join(line.format(x) for x in subjects))
        return load(spark, tmp_path, [{"path": f"{n}.nq", "format": "nq"} for n in "ab" if (tmp_path / f"{n}.nq").exists()])[0]
    write("a", "stuv")
    first = write("b", "vwx")
    place = str(tmp_path / "store")
    store.load_quads(spark, first, place)
    gone = [("g", x, 0) for x in "tx"]
    store.apply_update(spark, place, quads_of(spark, *gone), quads_of(spark, ("g", "new", 0)))
    second = write("a", "tvx")
    assert store.refresh_quads(spark, first, second, place) == [0]
    # t is read again and comes back; x comes back by source 0 alone; s and u went with their file
    assert held(spark, place) == {("g", k): v for k, v in
                                  {"t": [0], "v": [0, 1], "x": [0], "w": [1], "new": [-1]}.items()}
    assert store.refresh_quads(spark, second, second, place) == []


def test_reading_two_sources_needs_no_exchange(spark, tmp_path):
    place = str(tmp_path / "store")
    store.reload_quads(quads_of(spark, ("g", "a", 0), ("g", "a", 1), ("g", "b", 1)), place)
    graph = op.from_graphs(store.read_store(spark, place), ["http://g"])
    found = op.pattern(graph, Var("s"), Iri("http://p"), Var("o"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_two_loads_from_one_state_are_not_both_committed(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "store")
    store.reload_quads(quads_of(spark, ("g", "a", 0)), place)
    write = store._write

    def slow(rows, folder):
        monkeypatch.setattr(store, "_write", write)
        store.apply_update(spark, place, insert=quads_of(spark, ("g", "first", 0)))  # another load, meanwhile
        return write(rows, folder)
    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(store.ConcurrentLoad):
        store.apply_update(spark, place, insert=quads_of(spark, ("g", "second", 0)))
    assert {s for _, s in held(spark, place)} == {"a", "first"}
    last = store.current_load(spark, place)["load_id"]
    store._append(spark, f"{place}/claims", (last + 1, "unfinished"), store.CLAIMS)
    with pytest.raises(store.ConcurrentLoad):
        store.apply_update(spark, place, insert=quads_of(spark, ("g", "third", 0)))
    monkeypatch.setattr(store, "CLAIM_SECONDS", 0)  # an old claim without a load no longer counts
    store.apply_update(spark, place, insert=quads_of(spark, ("g", "third", 0)))
    assert {s for _, s in held(spark, place)} == {"a", "first", "third"}


def test_refresh_keeps_quads_of_another_source(spark, tmp_path):
    line = "<http://s/{0}> <http://p> <http://o> <http://g> .\n"
    for name in "ab":
        (tmp_path / f"{name}.nq").write_text("".join(line.format(i) for i in range(4)) + line.format(name))
    entries = [{"path": f"{n}.nq", "format": "nq"} for n in "ab"]
    first, _ = load(spark, tmp_path, entries)
    place = str(tmp_path / "store")
    store.load_quads(spark, first, place)
    assert store.read_store(spark, place).count() == 6
    (tmp_path / "a.nq").write_text(line.format("a"))
    second, _ = load(spark, tmp_path, entries)
    assert store.refresh_quads(spark, first, second, place) == [0]
    assert store.read_store(spark, place).count() == 6


def test_refresh_equals_full_reload(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.nt").write_text("".join(f"<http://{name}/{i}> <http://p> _:x .\n" for i in range(n)))
    entries = [{"path": f"{n}.nt", "format": "nt", "graph": f"http://g/{n}"} for n in "ab"]
    first, _ = load(spark, tmp_path, entries)
    place = str(tmp_path / "store")
    assert store.load_quads(spark, first, place) == "build"
    (tmp_path / "b.nt").write_text("<http://b/new> <http://p> _:x .\n")
    second, _ = load(spark, tmp_path, entries)
    assert store.refresh_quads(spark, first, second, place) == [1]
    full = str(tmp_path / "full")
    store.load_quads(spark, second, full)

    def rows(s):
        return sorted(map(str, store.read_store(spark, s).collect()))
    assert rows(place) == rows(full) and len(rows(full)) == 4
    assert store.decision(spark, place, identity.input_hash(second)) == "keep"
    gone, _ = load(spark, tmp_path, entries[:1])
    store.refresh_quads(spark, second, gone, place)
    assert store.read_store(spark, place).count() == 3


def test_updates_are_set_operations(spark):
    q = readers.read_nquads(lines_of(spark, "<http://a> <http://p> <http://o> .", "<http://a> <http://p> <http://o> <http://g> ."))
    assert store.insert_quads(q, q).count() == 2
    only_default = q.filter("g IS NULL")
    assert [r["g"] for r in store.delete_quads(q, only_default).collect()] == ["http://g"]
    assert distinct_quads(q.unionByName(q)).count() == 2


def test_dataset_catalog(spark, tmp_path):
    for name in ("zeta.yaml", "alpha.yaml", "two words.yaml", "note.txt", "sub/inner.yaml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x: 1\n")
    df = quality.dataset_catalog(spark, str(tmp_path), "http://host/sparql", "local", "sparql")
    assert [r["database"] for r in df.collect()] == ["alpha", "two", "zeta"]
    quality.write_catalog(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.splitlines()[:2] == ["database,endpoint_url,endpoint_name,keyword_search_api", "alpha,http://host/sparql,local,sparql"]


def test_short_turtle_ranges_share_tasks(spark, tmp_path):
    text = "@prefix ex: <http://e/> .\n" + "".join(f'ex:s{i} ex:p "{i}" .\nex:s{i} ex:p , .\n' for i in range(400))
    (tmp_path / "t.ttl").write_text(text)
    files = spark.createDataFrame([(0, 0, str(tmp_path / "t.ttl"), len(text))], "source_idx int, file_idx int, path string, size long")
    good, bad = parse_turtle(spark, files, "quarantine", range_bytes=40)
    assert sorted(r.s for r in good.collect()) == sorted(f"http://e/s{i}" for i in range(400))
    assert sorted(r.line for r in bad.collect()) == sorted(f"ex:s{i} ex:p , ." for i in range(400))
    folders = [f.rsplit("/", 1)[0] for f in good.inputFiles()]
    assert max(folders.count(f) for f in set(folders)) <= 4 * spark.sparkContext.defaultParallelism


def test_compressed_lines_are_dealt_evenly(spark, tmp_path):
    """Rows that come in one piece are compressed by several tasks."""
    made = spark.range(300).coalesce(1).selectExpr(
        "'http://g/' AS g", "concat('http://s/', id) AS s", "CAST(1 AS byte) AS s_kind", "'http://p/' AS p",
        "named_struct('kind', CAST(2 AS byte), 'value', CAST(id % 7 AS string), 'lang', '', 'dt', 'http://t/') AS o")
    path = str(tmp_path / "nq")
    writers.write_nquads(made, path, codec="bzip2")
    sizes = [r["count"] for r in spark.read.text(path).groupBy("_metadata.file_name").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 300
    assert max(sizes) <= 1.2 * min(sizes)
