"""Operators of the subpackage against brute-force versions on small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from oracle import compare, connect

from quadloom.llm import op3_pii, op9_secrets
from quadloom.llm.common import materialise
from quadloom.llm.elias_fano import Sequence, encode
from quadloom.llm.op2_jaccard_join import bitmap, index_part, keep_one, near_duplicates, prefix
from quadloom.llm.op4_warc import decode_block, read_archives, write_archives
from quadloom.llm.op5_mixing import mix, water_levels
from quadloom.llm.op6_decontamination import leaks, without_leaks
from quadloom.llm.op7_substring_dedup import (all_compact_windows, candidates, compact_windows, least_distinct, matching_passages,
                                             passages_by_document, repeated_passages, sketches, windows)
from quadloom.llm.op8_quality import keep_good, quality_digest
from quadloom.llm.op10_lm_scoring import lm_scores
from quadloom.llm.packed import pack, unpack
from quadloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, distance double, row int"


def table(spark, texts, sources=None):
    """Documents with columns whose names clash with those the operators add."""
    rows = [(i, t, "en", (sources or {}).get(i, "s0"), len(t or ""), 1.0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rng_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = [rng_text(rng, n) for n in (60, 80, 120, 30, 200, 12, 9, 61)]
    out = [None, "", " \n\t", "one two", "one two", "One TWO three", *base, base[0], base[1].upper()]
    for b in base[:5]:
        for _ in range(3):
            w = b.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.integers(len(w))] = "changed"
            out.append(" ".join(w))
    passage = rng_text(rng, 60)
    out += [rng_text(rng, 30) + " " + passage + " " + rng_text(rng, 40) for _ in range(6)]
    out += ["x " * 5000, "longword" * 3000, rng_text(rng, 4000)]
    return out


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def test_jaccard_join_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    sets = shingle_sets(texts)
    want = brute_components(sets)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_jaccard_join_on_common_passages(spark):
    """Texts that are mostly one common passage: frequent shingles come last, none is lost."""
    rng = np.random.default_rng(5)
    passage = rng_text(rng, 60)
    texts = [passage + " " + rng_text(rng, int(n)) for n in rng.integers(2, 25, 60)]
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == brute_components(shingle_sets(texts))


def test_jaccard_join_keeps_one_of_each_group(spark, texts):
    docs = table(spark, texts)
    kept = keep_one(docs.unionByName(docs.limit(1)))
    want = brute_components(shingle_sets(texts))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want})


def test_jaccard_join_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4)]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert keep_one(docs).count() == 3


def test_jaccard_join_tells_texts_of_one_id_apart(spark):
    """One id with two texts: whatever the order of rows, each text has its own links."""
    rng = np.random.default_rng(7)
    a, b = rng_text(rng, 60), rng_text(rng, 70)
    rows = [(2, a), (5, a + " more"), (5, b), (9, b + " end"), (9, b + " end"), (9, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string").selectExpr("*", "map(doc_id, 1) AS _id", "text AS sig")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
        assert got == [(2, 56, 2), (5, 57, 2), (5, 66, 5), (9, 0, 9), (9, 67, 5), (9, 67, 5)]
        kept = keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(2, a), (5, b), (9, "")])


def middling_texts(n, seed=11):
    """A text and ``n`` copies of it in which 12 to 20 of 150 words differ: some of them are linked."""
    rng = np.random.default_rng(seed)
    base = rng_text(rng, 150, 10**6).split()
    out = [" ".join(base)]
    for i in range(n):
        w = list(base)
        at = int(rng.integers(100))
        for j in range(int(rng.integers(12, 20))):
            w[(at + 3 * j) % 150 if i % 2 else int(rng.integers(150))] = f"x{i}y{j}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [0, 10**9])
def test_few_pairs_of_middling_likeness_reach_the_verification(spark, monkeypatch, few):
    """Pairs that share shingles but too few are told apart before their texts are read."""
    from quadloom.llm import op2_jaccard_join as op2
    texts = middling_texts(120)
    seen, verified = [], op2.verified
    monkeypatch.setattr(op2, "FEW_PAIRS", few)
    monkeypatch.setattr(op2, "verified", lambda pairs, t: seen.append(pairs.count()) or verified(pairs, t))
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    sets = shingle_sets(texts)
    assert [got[i] for i in range(len(texts))] == brute_components(sets)
    links = sum(4 * len(a & b) >= 3 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert seen[-1] <= 1.1 * links + 20
    assert len(seen) == 1 or not few


def test_jaccard_join_short_lists_take_no_leader_rounds(spark, monkeypatch):
    """Entries of short lists stay out of the leader rounds that the long lists of others take."""
    from quadloom.llm import op2_jaccard_join as op2
    rng = np.random.default_rng(12)
    many, few = [rng_text(rng, 150, 10**6).split()], []
    for i in range(60):
        many.append(many[0][:])
        many[-1][2 * i + 5] = f"x{i}"
    for _ in range(6):
        text = rng_text(rng, 150, 10**6)
        few += [text, text + " end"]
    texts = [" ".join(w) for w in many] + few
    seen, verified = [], op2.verified
    monkeypatch.setattr(op2, "verified", lambda pairs, t: seen.append(pairs.collect()) or verified(pairs, t))
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    sigs = [op2.signature(op2.token_set(op2.encoded([t.encode()])[0][0])) for t in texts]
    assert [got[i] for i in range(len(texts))] == brute_components(shingle_sets(texts))
    assert len(seen) > 1 and not {x for pair in seen[0] for x in pair} & set(sigs[61:])
    assert len(seen[-1]) == 6


def test_bitmap_is_folded_from_the_finer_one(spark):
    from quadloom.llm import op2_jaccard_join as op2
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    fine = dict(zip(op2.FINE_WORDS, bitmap(tokens, op2.FINE).tolist()))
    got = spark.createDataFrame([tuple(fine.values())], ", ".join(f"{w} bigint" for w in fine)).select(op2.folded()).first()
    assert list(got) == bitmap(tokens).tolist()


def test_components_stop_when_the_links_are_stars(spark, monkeypatch):
    """Links that are stars already take no round, others none after their last."""
    from quadloom.llm import components as module
    rounds, star = [], module._star
    monkeypatch.setattr(module, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    found = lambda rows: {r.node: r.component for r in module.components(
        spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert found([(0, 3), (5, 0), (7, 8), (8, 7), (4, 4)]) == {0: 0, 3: 0, 5: 0, 7: 7, 8: 7} and not rounds
    assert found([(i, i + 1) for i in range(9)]) == dict.fromkeys(range(10), 0) and rounds


def test_components_take_links_between_two_of_them_as_one(spark, monkeypatch):
    """New links go between the components found before, however many join the same two."""
    from quadloom.llm import components as module
    stars, entered = module._star, []
    monkeypatch.setattr(module, "_star", lambda edges, large: entered.append(edges.count()) or stars(edges, large))
    pairs = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    known = module.components(pairs([(0, i) for i in range(1, 30)] + [(30, i) for i in range(31, 60)] + [(80, 81)]))
    entered.clear()
    new = [(a, b) for a in range(5, 30) for b in range(35, 60)] + [(59, 70), (71, 70), (90, 91), (80, 81)]
    got = {r.node: r.component for r in module.components(pairs(new), known=known).collect()}
    assert got == {**{i: 0 for i in (*range(60), 70, 71)}, 80: 80, 81: 80, 90: 90, 91: 90}
    assert max(entered) <= 4
    assert known.count() == 62 and module.components(pairs([]), known=known).count() == 62


def test_jaccard_join_small_blocks_and_dropped_tables(spark, texts, monkeypatch):
    """Blocks flushed after few keys give the same components, and only the result stays stored."""
    import os

    from quadloom.llm import op2_jaccard_join as op2
    from quadloom.session import scratch_root
    monkeypatch.setattr(op2, "FLUSH", 300)
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(shingle_sets(texts))
    assert [n.split("-")[0] for n in set(os.listdir(root)) - before] == ["near"]


def test_adaptive_prefix_is_lossless():
    """Any two sets that reach the similarity share the smaller l of their prefixes."""
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 2 ** 63, 400).astype(np.uint64))
    heavy = np.unique(pool[::3] >> np.uint64(24))
    counts = rng.integers(8, 1000, len(heavy))
    for _ in range(300):
        x = np.sort(rng.choice(pool, rng.integers(1, 60), replace=False))
        y = np.sort(np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * .9)), replace=False), rng.choice(pool, 2)])))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            (p, lx), (q, ly) = prefix(x, heavy, counts), prefix(y, heavy, counts)
            step = min(lx, ly)
            assert len(np.intersect1d(p, q)) >= step
            small = p[:index_part(len(x), lx)] if len(x) <= len(y) else q[:index_part(len(y), ly)]
            assert len(np.intersect1d(small, q if len(x) <= len(y) else p)) >= step
            apart = sum(int(v).bit_count() for v in (bitmap(x) ^ bitmap(y)).view("<u8"))
            assert apart <= len(x) + len(y) - 2 * both and 7 * apart <= len(x) + len(y)


def test_jaccard_join_on_edited_copies(spark):
    """Copies of one text with growing edits: chains of links near the border of similarity."""
    rng = np.random.default_rng(11)
    base = rng_text(rng, 80).split()
    texts = []
    for k in range(90):
        own = list(base)
        for at in rng.choice(80, k % 6, replace=False):
            own[at] = f"edit{rng.integers(0, 1000)}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(90)] == brute_components(shingle_sets(texts))


def test_packed_blocks_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


# ---- url filter, warc ---------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)


def test_url_filter_edges(spark):
    from quadloom.llm.op1_url_filter import judge_urls
    from quadloom.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "http://example.org", "HTTP://EXAMPLE.org/es/x", "http://a.example.org/en/1?q",
            "http://notexample.org/es/", "http://bad.net/x", "http://sub.bad.net", "http://org/", "x://" + "a." * 3000 + "org/",
            "http://a.com/fr/", "http://a.com/de/#x", "http://a.com/fr", "http://..org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").selectExpr("*", "'x' AS rule", "1 AS row")
    listed = spark.createDataFrame([("bad.net",), (None,)], "host string")
    want = None
    for words in (1 << 19, 0):  # the cascade, and the join it gives way to
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, URL_RULES, listed, words).collect()}
        assert [got[i][3] for i in range(len(urls))] == [
            "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow", "allow",
            "allow", "block", "allow", "allow"]
        assert got[4][:3] == ("example.org", "/es/x", "example.org/es/") and got[5][2] == "example.org/en/1"
        assert got[0][:3] == ("", "", None) and got[3][:3] == ("example.org", "", None) and got[10][2] == "org/"
        assert got[6][2] == "org/"
        assert want in (None, got)
        want = got
    assert judge_urls(pages.limit(0), URL_RULES, listed.limit(0)).count() == 0


def test_url_filter_joins_at_the_default_when_the_list_is_too_large(spark, monkeypatch):
    from quadloom.llm import op1_url_filter
    from quadloom.llm.queries import URL_RULES

    pages = spark.createDataFrame([(1, "http://bad.net/x"), (1, "http://a.com/de/"), (2, "http://good.net/")], "page_id int, url string")
    listed = spark.createDataFrame([("bad.net",)], "host string")
    monkeypatch.setattr(op1_url_filter, "build_cascade", lambda *a: None)  # as for a list beyond the default
    got = op1_url_filter.judge_urls(pages, URL_RULES, listed).collect()
    assert sorted((r.host, r.verdict) for r in got) == [("a.com", "block"), ("bad.net", "block"), ("good.net", "allow")]


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" * 400
    rows = [(1, "http://a/1 x\r\ny", long), (5, "http://a/5", long), (3, None, long), (7, "u", None), (8, "u", "short"),
            (9, "u", "short"), (None, "u", "z" * 2000), (10, "u%41", "y" * 200000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload")
    path = str(tmp_path / "warc")
    write_archives(pages, path)
    got = {r.page_id: r for r in read_archives(spark, path).collect()}
    assert {k for k, r in got.items() if r.record_type == "revisit"} == {1, 3}
    assert got[1].refers_to == "<urn:page:5>" and got[1].payload is None and got[1].payload_bytes == len(long.encode())
    assert bytes(got[5].payload) == long.encode() and bytes(got[7].payload) == b"" and bytes(got[10].payload) == b"y" * 200000
    assert got[1].target_uri == "http://a/1 x\r\ny" and got[10].target_uri == "u%41"
    only = read_archives(spark, path).where("record_type = 'revisit' AND page_id IN (1, 5)")
    assert [r.page_id for r in only.collect()] == [1]
    assert {r.record_type for r in read_archives(spark, path, types="revisit", payload="false").collect()} == {"revisit"}
    empty = str(tmp_path / "none")
    write_archives(pages.limit(0), empty)
    assert read_archives(spark, empty).count() == 0
    assert decode_block(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_warc_append_and_overwrite(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"text {k}") for k in range(12)], "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    ids = lambda: sorted(r.page_id for r in read_archives(spark, path).collect())
    write_archives(pages.where("page_id < 4"), path)
    write_archives(pages.where("page_id BETWEEN 4 AND 7"), path)
    assert ids() == list(range(8))
    (tmp_path / "warc" / "_attempts" / "other").mkdir()  # of a write that still runs
    write_archives(pages.where("page_id >= 6"), path, mode="overwrite")
    assert ids() == list(range(6, 12))
    assert [p.name for p in (tmp_path / "warc" / "_attempts").iterdir()] == ["other"]
    write_archives(pages.limit(0), path, mode="overwrite")
    assert ids() == []


# ---- spans --------------------------------------------------------------------------------

def brute_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        s = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], op3_pii.KINDS.index(s[1])))


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], op9_secrets.KINDS.index(s[1])))


PIECES = ["password", "=", ":", " ", "token", "api_key", "ApiKey", '"', "abcdef", "AKIA", "ABCDEFGH1234", "0123456789abcdef",
          "é", "😀", "@", "a.b", ".", "com", "1.2.3.4", "+1", " (415) ", "555-2671", "4111 1111 1111 1111", "-", "256", "\n",
          "x@y.z", "eyJ", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "IBAN DE89370400440532013000 "]


@pytest.fixture(scope="module")
def messy():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(PIECES, rng.integers(0, 25))) for _ in range(400)]
    return [None, "", *texts, "a@" * 3000, "1." * 3000, "AKIA" * 3000, "+1 ((" * 2000, "eyJ" * 3000]


@pytest.mark.parametrize("query,brute,base", [
    (op3_pii.pii_digest, brute_pii, op3_pii.BASE_KINDS), (op9_secrets.secrets_digest, brute_secrets, op9_secrets.BASE_KINDS)])
def test_span_queries_equal_brute_force(spark, messy, query, brute, base):
    got = {r.doc_id: r for r in query(table(spark, messy)).collect()}
    for i, t in enumerate(messy):
        want = brute(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t[:200]
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in base] == [x for x in text.split(",") if x]
        count = Counter(k for _, k, _ in want)
        assert all(got[i][f"n_{k}"] == count[k] for k in base)
    assert query(table(spark, [])).count() == 0


def test_method_adds_spans_and_masks(spark):
    text = "pay DE89370400440532013000 now, account number: 12345678, http://bob:pw@host/x and a@b.c."
    assert {s[0] for s in op3_pii.find_spans(text, op3_pii._anchors())} == {"iban", "account", "login_url", "email"}
    docs = op3_pii.mask_pii(table(spark, [text, None, "clean"]))
    got = [r.text for r in docs.orderBy("doc_id").collect()]
    assert "DE893" not in got[0] and "[iban]" in got[0] and "a@b.c" not in got[0] and got[1:] == [None, "clean"]
    kinds = {op9_secrets.KINDS[k] for _, k, _ in op9_secrets.scan(
        b"ghp_" + b"A" * 36 + b" -----BEGIN RSA PRIVATE KEY----- eyJabcdefghijk.eyJabcdefghijk.abcdefghijkl", op9_secrets.compile_rules())}
    assert kinds == {"token", "pem", "jwt"}


# ---- mixing -------------------------------------------------------------------------------

def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds of resharing."""
    target, full, total = [0.0] * len(sizes), set(), sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(most * sizes[i] for i in full)
        for i in free:
            target[i] = rest * w[i] / sum(w[j] for j in free)
        over = {i for i in free if target[i] > most * sizes[i]}
        for i in over:
            target[i] = most * sizes[i]
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[10, 1000, 0, 5, 300], [7], [0, 0], [1, 1, 1, 1, 1, 1, 10 ** 9], [100, 3, 3, 3, 3, 3]])
def test_water_levels_equal_repeated_sharing(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes[:-1])] + [(None, sizes[-1])]
    got = {r.source: r.target for r in water_levels(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    assert [got[s] for s, _ in rows] == pytest.approx(fill(sizes))


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(4)
    texts = [None, ""] + [rng_text(rng, int(n)) for n in rng.integers(1, 300, 150)] + [rng_text(rng, 9000)]
    sources = {i: [None, "a", "b", "Z", "é"][min(4, int(rng.integers(9)))] for i in range(len(texts))}
    docs = table(spark, texts, sources)
    got = mix(docs).toPandas()
    size = got.set_index("doc_id")["size"]
    assert [size[i] for i in range(len(texts))] == [len((t or "").split()) for t in texts]
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    per = got.groupby([got["target"].round(6), "source_size"]).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= 1).all()
    again = mix(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    assert mix(docs.limit(0)).count() == 0 and mix(docs.where("text IS NULL")).first().taken == 0


def test_small_sources_get_their_slots(spark):
    """One-block sources at three times their size, at many places of the schedule."""
    from quadloom.llm.op5_mixing import schedule, with_missing_ranks

    slots, rows, at = 20_000, [], 0.0
    for sid in range(400):
        need = 3.0 if sid % 2 else 96.0
        rows.append((sid, need, at, at + need / 19_800))
        at = rows[-1][3]
    plan = spark.createDataFrame(rows, "sid int, need double, low double, high double")
    got = defaultdict(list)
    for r in with_missing_ranks(schedule(plan, slots), plan).collect():
        got[r.sid].append(r.rank)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert all(len(got[sid]) >= need for sid, need, _, _ in rows)


# ---- decontamination ----------------------------------------------------------------------

ITEMS = ["If Anna buys 12 apples for 3 dollars and gives Ben 12 of them, how many does Anna have left over today?",
         "tiny item here", "", None, "the quick brown fox jumps over the lazy dog near the river bank at night"]


def test_decontamination(spark):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")
    fox = ITEMS[4]
    texts = ["intro words " + fox + " outro words", "we say: if Clara buys 7 apples for 9 dollars and gives Dora 7 of them, how many "
             "does Clara have left over today? thanks", "if Clara buys 7 apples for 9 dollars and gives Dora 8 of them, how many does "
             "Eva have left over today? thanks", "a tiny item, here.", "nothing to see in this one at all, really nothing",
             None, "", fox.replace(" ", "%%% "), "the quick brown fox jumps over the lazy cat and then it sleeps all the day long"]
    found = {(r.doc_id, r.item_id) for r in leaks(table(spark, texts), bench).collect()}
    assert found == {(0, 4), (1, 0), (3, 1), (7, 4)}
    kept = without_leaks(table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8]
    assert leaks(table(spark, texts), bench.limit(0)).count() == 0
    assert leaks(table(spark, []), bench).count() == 0


# ---- passages -----------------------------------------------------------------------------

def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 50, 60).astype(np.uint64)  # with ties
    spans = compact_windows(keys, 10)
    for i in range(60):
        for j in range(i + 9, 60):
            at = [c for left, c, right in spans if left <= i <= c <= j <= right]
            assert len(at) == 1 and keys[at[0]] == keys[i:j + 1].min()


def test_compact_windows_keep_both_ends_of_a_repeated_stretch():
    rng = np.random.default_rng(8)
    stretch = rng.integers(1, 1 << 63, 11).astype(np.uint64)
    stretch[4] = 0
    before, after = (rng.integers(1 << 20, 1 << 63, n).astype(np.uint64) for n in (30, 30))
    spans = compact_windows(np.concatenate([before, np.tile(stretch, 50), after]), 12)
    least = [span for span in spans if span[1] in range(34, 34 + 550, 11)]
    assert least == [(0, 34, 609), (35, 34 + 49 * 11, 609)]
    # other text between equal minima: all of them stay
    keys = np.concatenate([x for k in range(20) for x in ([np.uint64(0)], rng.integers(1, 1 << 63, 10).astype(np.uint64))])
    assert {c for _, c, _ in compact_windows(keys, 12)} >= set(range(0, 209, 11))
    assert len(compact_windows(np.full(100_000, 7, np.uint64), 46)) == 2


def windows_one_by_one(keys, least):
    """The Cartesian tree node by node; of equal minima with one stretch between them the ends stay."""
    out, todo = [], [(0, len(keys))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        ties = [c for c in range(lo, hi) if keys[c] == min(keys[lo:hi])]
        kept = [c for k, c in enumerate(ties) if not 0 < k < len(ties) - 1
                or keys[ties[k - 1]:c] != keys[c:ties[k + 1]]]
        out += [(a, c, hi - 1) for a, c in zip([lo] + [c + 1 for c in kept], kept) if hi - a >= least]
        todo += [(a, b) for a, b in zip([lo] + [c + 1 for c in ties], ties + [hi])]
    return sorted(out, key=lambda span: span[1])


def test_compact_windows_of_many_texts():
    rng = np.random.default_rng(10)
    texts = []
    for n in (3, 12, 40, 90, 150) * 12:
        line = rng.integers(0, 1 << 40, rng.integers(1, 14)).tolist()
        texts.append([rng.integers(0, 4, n).tolist(), rng.integers(0, 1 << 62, n).tolist(), (line * 20)[:n],
                      rng.integers(0, 1 << 40, n).tolist() + line * 9 + rng.integers(0, 1 << 40, n).tolist()][rng.integers(4)])
    keys, ends = np.array([x for t in texts for x in t], np.uint64), np.cumsum([len(t) for t in texts])
    for least in (1, 2, 9, 16):
        got = sorted(zip(*[column.tolist() for column in all_compact_windows(keys, ends, least)]))
        assert got == sorted((k, *span) for k, t in enumerate(texts) for span in windows_one_by_one(t, least))


def test_compact_windows_take_no_step_for_each():
    """The work of the interpreter does not grow with the number of texts and windows."""
    keys, calls = np.random.default_rng(11).integers(1, 1 << 63, 200_000).astype(np.uint64), []
    for n in (10, 400):
        calls.append(0)
        sys.setprofile(lambda *event: calls.__setitem__(-1, calls[-1] + 1))
        try:
            found = all_compact_windows(keys, np.arange(1, n + 1) * (len(keys) // n), 46)
        finally:
            sys.setprofile(None)
    assert len(found[0]) > 7000 and max(calls) < 500


def test_first_leaders_need_one_shuffle(spark):
    rng = np.random.default_rng(12)
    passage = rng_text(rng, 80, 10 ** 6)
    rows = materialise(windows(table(spark, [passage + " " + rng_text(rng, 60, 10 ** 6) for _ in range(4)]), 3), "windows")
    pairs = candidates(rows)
    assert len(re.findall(r"\bExchange ", pairs._jdf.queryExecution().simpleString())) == 1
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 2), (0, 3)}


def test_surroundings_of_minima():
    rng = np.random.default_rng(9)
    for n in (10, 11, 40, 200):
        s = rng.integers(0, 12, n).astype(np.uint64) << np.uint64(55)
        spots = np.arange(n)
        few, bits = least_distinct(s, spots, 10), sketches(s, spots, 10)
        for c in spots:
            assert few[c] == min(len(set(s[i:i + 10])) for i in range(max(c - 9, 0), min(c, n - 10) + 1))
            assert int(np.bitwise_count(bits[c].view(np.uint64)).sum()) == len(set(s[max(c - 9, 0):c + 10]))


def test_passage_among_repeated_lines(spark):
    word = lambda k: f"w{k * 7919 % 1009}x{k}"
    line = " ".join(word(k) for k in range(9))
    passage = " ".join(word(k) for k in range(100, 170))
    # the lines stand in both, a different number of times; the passage follows them
    rows = [(1, "\n".join([line] * 40 + [passage])), (2, "\n".join([line] * 70 + [passage])),
            (3, " ".join(word(k) for k in range(300, 500)))]
    got = passages_by_document(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert any(r.doc_id == 1 and r.end_word == 40 * 9 + 70 for r in got)


def test_many_texts_around_one_phrase(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"v{rng.randrange(10 ** 9)}" for _ in range(n))
    phrase = " ".join(f"p{k}" for k in range(14))
    passages = [fresh(60) for _ in range(3)]
    # all hold the phrase, 3k and 3k + 1 also a passage behind it
    rows = [(k, " ".join([fresh(60), phrase, passages[k // 3] if k < 9 and k % 3 < 2 else fresh(60), fresh(60)])) for k in range(60)]
    pairs = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.a, r.b))) for r in pairs} == {(0, 1), (3, 4), (6, 7)}


def test_repeated_passages(spark, texts):
    docs = table(spark, texts)
    got = passages_by_document(repeated_passages(docs)).toPandas()
    words = [(t or "").lower().split() for t in texts]
    runs = defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - 54):
            runs[tuple(w[j:j + 55])].add(i)
    want = {i for s in runs.values() if len(s) > 1 for i in s}
    assert want <= set(got["doc_id"]) and len(want) > 8
    lone = {i for i, w in enumerate(words) if len(w) < 50} | {len(texts) - 1, len(texts) - 2, len(texts) - 3}
    assert not lone & set(got["doc_id"])
    assert ((got["end_word"] - got["start_word"]) >= 50).all()
    assert repeated_passages(docs.limit(0)).count() == 0


def test_passages_keep_links_the_leader_does_not_have(spark):
    """A-B and B-C are similar, A-C is not, and A leads: C has no partner but B."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(30):
        first = [f"u{rng.integers(10 ** 9)}" for _ in range(60)]
        second = [*first[:20], "edit", *first[21:]]
        third = [*second[:40], "other", *second[41:]]
        texts += [" ".join(x) for x in (first, second, third)]
    pairs = {tuple(sorted((r.a, r.b))) for r in repeated_passages(table(spark, texts), hashes=12).collect()}
    assert pairs == {p for i in range(0, 90, 3) for p in ((i, i + 1), (i + 1, i + 2))}


def test_passages_tell_texts_of_one_id_apart(spark):
    """An id with a short and a long text: places of one are not looked up in the other."""
    rng = np.random.default_rng(21)
    p, q = rng_text(rng, 80, 10 ** 6), rng_text(rng, 90, 10 ** 6)
    lead = rng_text(rng, 400, 10 ** 6)
    rows = [(1, p), (2, q), (5, lead + " " + p), (5, q), (5, "short one"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(*sorted((r.a, r.b)), r.a_end - r.a_start) for r in repeated_passages(docs, rounds=1).collect()}
    assert got == {(1, 5, 80), (2, 5, 90)}


def test_passages_are_joined_across_longer_gaps():
    """Four replaced words in the middle of 95 leave 83 of 99 shingles, but no half is long enough."""
    rng = np.random.default_rng(6)
    make = lambda n: rng.integers(1, 2 ** 63, n).astype(np.uint64)
    for drop, width in ((45, 8), (45, 12), (20, 9), (70, 10)):
        body, x, y = make(91), make(40), make(70)
        own = np.concatenate([body[:drop], make(width - 3), body[drop + width:]])
        a, b = np.concatenate([x, body, make(30)]), np.concatenate([y, own, make(90)])
        for at in (5, 85):
            spot = at if at < drop else at + len(own) - len(body)
            got = matching_passages(a, b, [(40 + at, 70 + spot)])
            assert got == [(40, 131, 70, 70 + len(own))]
    far = np.concatenate([body[:45], make(40), body[45:]])
    assert [p[2:] for p in matching_passages(body, far, [(5, 5), (80, 120)])] == [(85, 131)]


# ---- quality ------------------------------------------------------------------------------

def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + k for s in at.values() if len(s) > 1 for i in s for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_outliers(spark, texts):
    rng = np.random.default_rng(8)
    clean = [rng_text(rng, int(n)) for n in rng.integers(20, 200, 80)]
    junk = ["### $$$ %%% ||| " * 20 + rng_text(rng, 30), " ".join("z" * 200 for _ in range(15)) + rng_text(rng, 9)]
    extra = ["a b c d e f g " * 3 + "x\n\n y\nx\n y\nx", "😀 é\u00a0b\u2003c " * 4, "l1\nl1\n \n \nl2"]
    all_texts = [*texts, *clean, *junk, *extra]
    docs = table(spark, all_texts)
    got = {r.doc_id: r for r in quality_digest(docs).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(all_texts):
        want = brute_counts(t)
        assert tuple(got[i][n] for n in names) == want, t
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i].base_failed and got[i].kept)
    first = len(texts)
    assert all(got[i].kept for i in range(first, first + 80))
    assert not any(got[i].kept for i in range(first + 80, first + 82))
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert quality_digest(docs.limit(0)).count() == 0
    assert quality_digest(docs.where(f"doc_id = {first}")).first().kept


# ---- language model -----------------------------------------------------------------------

def test_elias_fano_finds_all_and_only_members():
    rng = np.random.default_rng(9)
    for n, universe in ((0, 100), (1, 5), (50, 60), (3000, 2 ** 40), (3000, 2 ** 64 - 1), (500, 1000)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        seq = Sequence(encode(values, universe, "k"), "k")
        asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
        want = [int(np.searchsorted(values, x)) if x in set(values.tolist()) else -1 for x in asked]
        assert seq.find(asked).tolist() == want


def test_scores_equal_brute_force(spark, texts):
    docs = table(spark, texts)
    got = {r.doc_id: r for r in lm_scores(docs).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["\n", *w], w))
    n, v = sum(one.values()), len(one)
    unigram = lambda x: (one[x] + 1) / (n + v + 1)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(w), n)
        assert r.n_known == sum(one[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10(unigram(x)) for x in w), rel_tol=1e-9)
        want = sum(math.log10((two[c, x] + 2000 * unigram(x)) / (one[c] + 2000)) for c, x in zip(["\n", *w], w))
        assert math.isclose(r.score, want, abs_tol=2e-4 * len(w))
    assert lm_scores(docs.limit(0)).count() == 0
    assert lm_scores(spark.createDataFrame([(3, "a"), (None, None)], "doc_id bigint, text string")).count() == 2


# ---- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = [docs], docs.columns
    for name, stage in cp.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf), "stage"))
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    verdict = {r.doc_id for r in quality_digest(docs).where("kept").collect()}
    assert ids[1] == sorted(verdict)
    text = {r.doc_id: r.text for r in seen[1].collect()}
    order = sorted(text)
    comp = brute_components(shingle_sets([text[i] for i in order]))
    assert ids[2] == sorted({order[c] for c in comp})
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t).lower().split())
    held = {i for i in ids[2] if any(plain(b) in plain(text[i]) for b in bench)}
    assert not held & set(ids[3]) and set(ids[2]) - set(ids[3]) == held
    masked = {r.doc_id: r.text for r in seen[4].collect()}
    assert ids[4] == ids[3] and all(not brute_pii(t or "") for t in masked.values())
    assert ids[5] == ids[4] and pd.Series([r.taken for r in seen[5].collect()]).sum() > 0


def test_leaks_in_other_case_or_line_breaks(spark):
    item = ("In spring young Anna walked 12 km to visit her Uncle Paul in Bremen and paid 3 euros for the ferry, "
            "then rested near Lake Constance with her friend Tom for 5 days")
    other = "while nobody else went anywhere at all that day because the weather was far too cold for walking about outside"
    copies = [item, item.lower(), item.upper(), item.replace(" ", "\n"), item.replace(" ", "  "),
              f"{other} {item.lower()} {other}", other, None, ""]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    docs = table(spark, copies)
    assert sorted(r.doc_id for r in leaks(docs, bench).collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in without_leaks(docs, bench).collect()) == [6, 7, 8]
    empty = bench.where("item_id < 0")
    assert without_leaks(docs, empty).count() == len(copies) and leaks(docs, empty).count() == 0
