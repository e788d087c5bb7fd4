"""Phrase mining, source divergence and the vector join against brute-force versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect

from quadloom.llm import op11_collocations as mining
from quadloom.llm.op11_collocations import block_phrases, collocations, frequent_phrases, text_blocks
from quadloom.llm.op12_divergence import billionths, divergences
from quadloom.llm.op13_embedding_dedup import Cells, choose_pivots, classes, near_vectors, range_join
from quadloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, phrase string, n bigint, rank int"
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, rows):
    """Rows (text, lang, source), with further columns whose names clash with those in use."""
    return spark.createDataFrame([(i, *r, "x", "y", 7, 1) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(None, "en", "a"), ("", None, None), (" \t\n.,", "en", "b"), (None, None, "a"), ("\x00\x7f Ärger ärger", "de", "a"),
           ("lone words", "xx", "a"), ("lone words", "xx", "b"), ("word " * 3000, "en", "big"), ("A" * 9000, "en", "big")]
    for i in range(160):
        lang = ["en", "de", None][i % 3]
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 60) % 40]
        words[10:13] = ["New", "York", "City"]
        words[30:32] = ["naïve", "Bayes"]
        marks = rng.choice([" ", " ", " ", ", ", ".", "\n", "\t", " \xa0 ", "\x0b"], len(words))
        out.append(("".join(w + m for w, m in zip(words, marks)), lang, [f"s{i % 4}", None][i % 7 == 0]))
    return out + out[40:60]


# ---------------------------------------------------------------- phrases
def phrase_counts(rows, least):
    f, n = Counter(), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {k: v for k, v in f.items() if v >= least}, n


def best_phrases(rows, least, share, top):
    f, n = phrase_counts(rows, least)
    around = Counter()
    for (lang, *w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, *w[i:i + m]] = max(around[lang, *w[i:i + m]], v)
    found = defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) > 1 and 100 * around[lang, *w] < share * a:
            parts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(parts))
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize("size, top", [(8 << 20, 2000), (700, 15)])
def test_collocations_equal_brute_force(spark, rows, size, top):
    got = collocations(documents(spark, rows), 12, 80, top, size, 900).collect()
    want = best_phrases(rows, 12, 80, top)
    assert sorted(tuple(x) for x in got) == want
    assert any(x[2] == "new york city" for x in want) and any(x[0] == "und" for x in want)


def test_phrases_of_one_fingerprint_are_told_apart(spark, rows, monkeypatch):
    """With fingerprints of 9 bits nearly all collide; the counts still come from the words."""
    monkeypatch.setattr(mining, "mixed", lambda x: (x & np.uint64(511)) << np.uint64(64 - mining.BITS))
    ids, piece, words = mining.tokens(b"a b a b\nc d a\na b")
    assert len(ids) == 9 and len(set(piece.tolist())) == 3 and words == [b"a", b"b", b"c", b"d"]
    got = block_phrases(b"a b a b\nc d a\na b", "en", np.arange(512, dtype=np.uint64))
    assert got == {b"a": 4, b"b": 3, b"c": 1, b"d": 1, b"a b": 3, b"b a": 1, b"c d": 1, b"d a": 1, b"a b a": 1,
                   b"b a b": 1, b"c d a": 1, b"a b a b": 1}


def test_counts_beyond_64_bits_in_products(spark):
    huge = 3_000_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a", 1, huge), ("en", "b", 1, huge), ("en", "a b", 2, huge - 1)],
                                    "lang string, phrase string, words int, f bigint")
    assert mining.scored(phrases).first().score == 2000000 * (huge - 1) // (2 * huge)


def test_long_texts_are_cut_between_pieces(spark):
    text = ", ".join(f"p{i} q r" for i in range(500))
    docs = documents(spark, [(text, "en", "a"), ("q r " * 2000, "en", "a")])
    blocks = text_blocks(docs, 1000)
    assert blocks.count() > 5
    got = {x.phrase: x.f for x in frequent_phrases(blocks, 30, 500).collect()}
    assert got == {"q": 2500, "r": 2500, "q r": 2500, "r q": 1999, "q r q": 1999, "r q r": 1999, "q r q r": 1999,
                   "r q r q": 1998}


def test_no_phrases(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(None, None, None), ("", "en", "a")])).collect() == []


# ---------------------------------------------------------------- divergence
def brute_divergences(rows, least, top):
    tf, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        tf[lang, source].update(w)
        df[lang].update(set(w))
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        terms = [t for t, c in df[lang].items() if c >= least]

        def scaled(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(terms)) for t in terms}

        p = {s: scaled(tf[lang, s]) for s in own}
        q = scaled(sum((tf[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in own - {s})
            leaders = sorted((q[t] - p[s][t], t.encode()) for t in terms if tf[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", leaders)):
                out += [(lang, s, part, x.decode(), -v, i) for i, (v, x) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, cells", [(30, 50, 500_000), (3, 4, 20)])
def test_divergences_equal_brute_force(spark, rows, least, top, cells):
    got = divergences(documents(spark, rows), least, top, cells).collect()
    want = brute_divergences(rows, least, top)
    assert sorted(tuple(x) for x in got) == want
    assert ("xx", "a", "pair", "b", 0, 1) in want and any(x[0] == "" for x in want)


def test_partial_counts_sent_early_add_up(spark, rows, monkeypatch):
    from quadloom.llm import op12_divergence
    monkeypatch.setattr(op12_divergence, "HELD_ROWS", 10)
    tables = documents(spark, rows).select("lang", "source", "text").fillna("").toArrow().to_batches(max_chunksize=7)
    parts = list(op12_divergence._partial(iter(tables)))
    got = Counter()
    for part in parts:
        for row in part.to_pylist():
            got[row["lang"], row["source"], row["term"]] += row["n"]
    want = Counter()
    for text, lang, source in rows:
        for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            want[lang or "", source or "", x.translate(LOWER)] += 1
    assert got == want and len(parts) > 5


def test_billionths_are_exact():
    rng = np.random.default_rng(1)
    total = np.concatenate([rng.integers(1, 9 * 10**15, 2000), rng.integers(1, 50, 500)])
    count = (total * rng.random(len(total))).astype(np.int64)
    count[::7] = total[::7]
    assert billionths(count, total).tolist() == [10**9 * int(c) // int(t) for c, t in zip(count, total)]


def test_no_sources(spark):
    assert divergences(documents(spark, [])).collect() == []
    assert [tuple(x) for x in divergences(documents(spark, [(None, None, None)])).collect()] == []


# ---------------------------------------------------------------- vectors
def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                                 "vec_id bigint, embedding array<double>, node int, component int, links int")


def brute_links(rows, least=0.95):
    def unit(e):
        x = np.array([np.nan if v is None else v for v in e or []], float)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            return None
        x /= np.abs(x).max()
        return x / np.sqrt(x @ x)

    units = [unit(e) for _, e in rows]
    near = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y)
             and x @ y >= least] for i, x in enumerate(units)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(near[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((vec_id, len(near[i]), least_id, vec_id is not None and vec_id == least_id))
    return sorted(out, key=str)


def clustered(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dims))
    x = centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, dims))
    return [(int(i), [float(v) for v in e]) for i, e in enumerate(x)]


ODD = [(None, [1.0, 0.0, 0.0]), (None, [0.99, 0.1, 0.0]), (900, [2.0, 0.0, 0.0]), (901, None), (902, []), (903, [0.0, 0.0, 0.0]),
       (904, [1.0, None, 0.0]), (905, [float("nan"), 1.0, 0.0]), (906, [float("inf"), 1.0, 0.0]), (907, [1.0, 0.0]),
       (908, [1.0, -0.0, 0.0]), (908, [0.0, 1.0, 0.0]), (908, [0.0, 1.0, 0.0]), (909, [1e200, 0.0, 0.0]), (910, [5e-324, 0.0, 0.0]),
       (911, [0.95, sqrt := (1 - 0.95**2) ** 0.5, 0.0]), (912, [0.95, -sqrt, 0.0]), (901, None)]


@pytest.mark.parametrize("dims, spread, chunk, pivots", [
    (3, 0.1, 40, 6), (16, 0.08, 30, 8), (16, 0.2, 16384, None), (64, 0.15, 25, 5), (8, 0.02, 1000, 12)])
def test_vector_join_equals_brute_force(spark, dims, spread, chunk, pivots):
    rows = clustered(dims, 260, dims, spread) + ODD
    got = near_vectors(vectors(spark, rows), 0.95, chunk, pivots).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_links(rows)


def test_hot_group_of_near_copies(spark):
    """A third of all vectors around one point: chunks of one cell, most of them sure partners."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=24)
    hot = [(int(i), [float(v) for v in centre + 0.08 * rng.normal(size=24) * (i % 4)]) for i in range(150)]
    rows = hot + [(i + 150, e) for i, e in clustered(9, 300, 24, 0.1)]
    got = near_vectors(vectors(spark, rows), 0.95, 20, 6).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_links(rows)
    found = range_join(classes(vectors(spark, rows))[1], 0.95, 1000, 6)
    assert found.count() <= 2 * 450  # a row a vector and cell, never a row a pair


def test_pivots_prune_separate_groups():
    """Where groups lie apart a vector is copied to few cells, and never lost to a partner's."""
    rows = np.array([e for _, e in clustered(4, 400, 6, 0.02)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    cells = Cells(choose_pivots(rows, 30, 0.3163), 0.3163)
    d = cells.distances(rows)
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home]
    cells.nearest = np.array([own[home == c].min(initial=9) for c in range(30)])
    cells.farthest = np.array([own[home == c].max(initial=-9) for c in range(30)])
    visits = cells.visits(d, home)
    assert visits.sum(axis=1).mean() < 6
    for i, j in zip(*np.nonzero(rows @ rows.T >= 0.95)):
        assert home[i] == home[j] or visits[i, home[j]] != visits[j, home[i]]


def test_no_vectors(spark):
    assert near_vectors(vectors(spark, [])).collect() == []
    assert [tuple(x) for x in near_vectors(vectors(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("name", ["op11_collocations", "op12_divergence", "op13_embedding_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
