"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles.  All documents order their shingles
alike: frequent ones last, ties by hash.  Two sets of overlap o share at least l shingles among
the first n - o + l of each, for every l up to o.  Each document picks its own l: it lengthens its
prefix while the estimated number of candidates, which must then share l shingles, falls enough to
pay for the longer lists.  Two documents are candidates when they share as many prefix shingles as
the smaller of their l.  Two given sets must share t = 3/7 of their joint size, so their first l
matches lie among the first n - t + l of each, mostly fewer than the prefix: matches further back are
not counted for the pair.  As t is at least 6/7 of the smaller set, that one meets others only with its
first n - 6n/7 + l shingles, its index part; costs are estimated there, and a list without an entry of
any index part is left out.  A pair that meets must also agree in a bitmap: each set keeps the parity of its
shingles in 256 classes, and two sets differ in at least as many shingles as their bitmaps in bits.

Classes of equal sets are joined once.  Within a long list, sets are first compared with
one leader, each list with its own; the sets that are now in one component need no more comparison,
so a group of near-copies costs links in proportion to its size.  All remaining candidate pairs across
components must agree in a finer bitmap of 1024 classes, and are then verified, so no link between
components is missed.  Short lists hold few pairs for their entries and are met as a whole, without
leaders before; whether a list is short hangs on the list alone, not on the others of the table.

Which shingles count as frequent only shapes the order.  At most ``MAX_HEAVY`` of them, the most
frequent, are sent to the tasks; the result is the same for any choice.

Shingles are compared by 64-bit hashes.  Edge cases: NULL and empty texts have the empty set and are
linked with nothing; shorter texts are one shingle; equal texts and repeated rows share a class;
NULL ids belong to their class but never name it, and a class without any id is compared with no
other; an empty table gives no rows; rows of one id with different texts are told apart by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, by_bucket, by_bytes, encoded, map_arrow, materialise, shingles, utf8
from .components import components
from .packed import DROP, FLUSH, gather, pack, signature, splits, unpack

MAX_HEAVY = 1 << 20  # 16 MB
LEAST_HEAVY = 8
STEPS = (1, 2, 3, 4, 6, 8, 12, 16)
VERIFY_COST = 20.0  # of one candidate, in list entries
ROUNDS = 3
FEW_PAIRS = 8  # for each entry of a list: one that holds no more is met as a whole, without leaders before
CLASSES = 256
FINE = 4 * CLASSES
WORDS = tuple(f"w{k}" for k in range(CLASSES // 64))  # 64 bits each of a set's bitmap
FINE_WORDS = tuple(f"v{k}" for k in range(FINE // 64))  # and of its finer one


def token_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text from its word hashes."""
    return np.unique(shingles(h))


def alpha(n):
    """Least overlap of a set of ``n`` with any partner: three quarters of it, rounded up."""
    return -(-3 * n // 4)


def index_part(n, step):
    """Number of first shingles with which a set of ``n`` meets sets of its size or larger."""
    return n - -(-6 * n // 7) + step


def bitmap(tokens: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Parity of the number of tokens in each of ``classes`` classes, as signed words."""
    odd = np.bincount((tokens & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def folded() -> list[Column]:
    """The words of the bitmap from those of the finer one, whose classes each lie in one of its."""
    step = len(WORDS)
    return [F.expr(" ^ ".join(FINE_WORDS[k::step])).alias(w) for k, w in enumerate(WORDS)]


def _int_block(x, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def text_id() -> Column:
    """Names a text among those of one doc_id."""
    return F.xxhash64(utf8(F.col("text")))


def profile(docs: DataFrame, n_buckets: int) -> DataFrame:
    """One pass: a row (doc_id, text_id, sig, n) for every document in bucket -1, and blocks of
    shingle fingerprints of the distinct sets of each task in buckets 0 and up."""

    def run(batches):
        keys, size, seen = [], 0, set()

        def flush():
            f = np.sort(np.concatenate(keys) >> DROP)
            at = splits(f, n_buckets)
            parts = [b for b in range(n_buckets) if at[b] < at[b + 1]]
            none = pa.nulls(len(parts), pa.int64())
            return {"bucket": pa.array(parts, pa.int32()), "doc_id": none, "text_id": none, "sig": none,
                    "n": pa.nulls(len(parts), pa.int32()), **dict.fromkeys(FINE_WORDS, none),
                    "block": pa.array([pack(f[at[b]:at[b + 1]]) for b in parts], pa.binary())}

        for batch in by_bytes(batches):
            sets = [token_set(h) for h in encoded(batch.column("text").to_pylist())[0]]
            sigs = [signature(s) for s in sets]
            bits = np.array([bitmap(s, FINE) for s in sets], np.int64).reshape(-1, len(FINE_WORDS))
            yield {"bucket": pa.array([-1] * len(sets), pa.int32()), "doc_id": batch.column("doc_id"),
                   "text_id": batch.column("text_id"), "sig": pa.array(sigs, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()),
                   **{w: pa.array(np.ascontiguousarray(bits[:, k])) for k, w in enumerate(FINE_WORDS)},
                   "block": pa.nulls(len(sets), pa.binary())}
            for s, g in zip(sets, sigs):
                if len(s) and g not in seen:
                    seen.add(g)
                    keys.append(s)
                    size += len(s)
            if size >= FLUSH:
                yield flush()
                keys, size, seen = [], 0, set()
        if size:
            yield flush()

    return map_arrow(docs.select("doc_id", text_id().alias("text_id"), utf8(F.col("text")).alias("text")), run,
                     "bucket int, doc_id bigint, text_id bigint, sig bigint, n int, "
                     + "".join(f"{w} bigint, " for w in FINE_WORDS) + "block binary")


def frequent(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(f, count) of the fingerprints held by ``LEAST_HEAVY`` sets or more."""

    def run(batches):
        for rows in gather(batches, ["block"]).values():
            f, count = np.unique(np.concatenate([unpack(b) for b, in rows]), return_counts=True)
            keep = count >= LEAST_HEAVY
            yield {"f": pa.array(f[keep].astype(np.int64)), "count": pa.array(count[keep].astype(np.int64))}

    return map_arrow(by_bucket(blocks, n_buckets), run, "f bigint, count bigint")


def heavy_list(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent fingerprints and their counts, at most ``MAX_HEAVY``, sorted."""
    scale = F.floor(F.log2("count") * 4)  # a bounded number of classes
    classes = counts.groupBy(scale.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    total, least = 0, None
    for r in classes:
        total += r.n
        if total > MAX_HEAVY:
            break
        least = r.c
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = counts.where(scale >= least).toPandas().sort_values("f")
    return got["f"].to_numpy().astype(np.uint64), got["count"].to_numpy()


def prefix(tokens: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The document's prefix and its l."""
    n = len(tokens)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens >> DROP), len(heavy) - 1)
        weight = np.where(heavy[at] == tokens >> DROP, counts[at], 0)
    else:
        weight = np.zeros(n, np.int64)
    first = n - alpha(n)
    if weight.any():
        order = np.lexsort((tokens, weight))
        tokens, weight = tokens[order], weight[order]
        sums = np.cumsum(weight)
        best, least = 1, None
        for step in STEPS:
            if step > alpha(n):
                break
            entries = float(sums[min(index_part(n, step), n) - 1])
            cost = entries + VERIFY_COST * entries / step
            if least is None or cost < least:
                best, least = step, cost
    else:
        best = 1
    return tokens[:first + best], best


def postings(docs: DataFrame, n_buckets: int, heavy) -> DataFrame:
    """(f, sig, n, l, pos, held): prefix entries of shingles that at least two different sets hold, with
    their place in the common order and the length of their list."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded by MAX_HEAVY

    def emit(batches):
        keys, owners, table, size, seen = [], [], [], 0, set()

        def flush():
            f = np.concatenate(keys) >> DROP
            owner = np.repeat(np.arange(len(table)), owners)
            pos = np.concatenate([np.arange(k) for k in owners])
            order = np.argsort(f, kind="stable")
            f, owner, pos = f[order], owner[order], pos[order]
            info = np.array(table, np.int64)
            at = splits(f, n_buckets)
            rows = []
            for b in range(n_buckets):
                if at[b] < at[b + 1]:
                    who, local = np.unique(owner[at[b]:at[b + 1]], return_inverse=True)
                    rows.append((b, pack(f[at[b]:at[b + 1]]), _int_block(local, "<u4"),
                                 _int_block(info[who, 0], "<i8"), _int_block(info[who, 1], "<i4"),
                                 _int_block(info[who, 2], "u1"), _int_block(pos[at[b]:at[b + 1]], "<i4")))
            return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(
                [("bucket", pa.int32())] + [(c, pa.binary()) for c in ("f", "owner", "sig", "n", "l", "pos")])}

        for batch in by_bytes(batches):
            for h in encoded(batch.column("text").to_pylist())[0]:
                tokens = token_set(h)
                sig = signature(tokens)
                if not len(tokens) or sig in seen:
                    continue
                seen.add(sig)
                chosen, step = prefix(tokens, *sent.value)
                keys.append(chosen)
                owners.append(len(chosen))
                table.append((sig, len(tokens), step))
                size += len(chosen)
            if size >= FLUSH:
                yield flush()
                keys, owners, table, size, seen = [], [], [], 0, set()
        if size:
            yield flush()

    def meet(batches):
        for rows in gather(batches, ["f", "owner", "sig", "n", "l", "pos"]).values():
            parts = []
            for f, owner, sig, n, step, pos in rows:
                o = np.frombuffer(owner, "<u4")
                parts.append((unpack(f), np.frombuffer(sig, "<i8")[o], np.frombuffer(n, "<i4")[o],
                              np.frombuffer(step, "u1")[o], np.frombuffer(pos, "<i4")))
            f, sig, n, step, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(f, kind="stable")
            f = f[order]
            shared = np.zeros(len(f), bool)
            same = f[1:] == f[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            order, f = order[shared], f[shared]
            sig, n, step, pos = sig[order], n[order], step[order], pos[order]
            order = np.lexsort((sig, f))  # equal sets from several tasks become one entry
            f, sig, n, step, pos = f[order], sig[order], n[order], step[order], pos[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (sig[1:] != sig[:-1])
            f, sig, n, step, pos = f[new], sig[new], n[new], step[new], pos[new]
            keep = held = np.zeros(len(f), np.int64)
            if len(f):
                starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                sizes = np.diff(np.append(starts, len(f)))
                met = np.logical_or.reduceat(pos < index_part(n, step.astype(np.int64)), starts)
                keep, held = np.repeat(met & (sizes > 1), sizes), np.repeat(sizes, sizes)
            keep = keep.astype(bool)
            yield {"f": pa.array(f[keep].astype(np.int64)), "sig": pa.array(sig[keep]),
                   "n": pa.array(n[keep]), "l": pa.array(step[keep].astype(np.int32)), "pos": pa.array(pos[keep]),
                   "held": pa.array(held[keep])}

    blocks = map_arrow(docs.select(utf8(F.col("text")).alias("text")), emit,
                       "bucket int, f binary, owner binary, sig binary, n binary, l binary, pos binary")
    return map_arrow(by_bucket(blocks, n_buckets), meet, "f bigint, sig bigint, n int, l int, pos int, held bigint")


def texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(sig, text): one text for every class in ``named(sig, rep, rep_text)``."""
    texts = docs.select(F.col("doc_id").alias("rep"), text_id().alias("rep_text"), utf8(F.col("text")).alias("text"))
    return texts.join(named, ["rep", "rep_text"]).dropDuplicates(["rep", "rep_text"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: one join for each side, of the texts it needs."""
    side = lambda k: texts.select(F.col("sig").alias(k), F.col("text").alias(f"t{k}")).join(
        pairs.select(k), k, "left_semi")
    rows = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a, texts_b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            good, held = [], (None, None)
            for k in range(len(a)):
                if held[0] != a[k]:
                    held = (a[k], token_set(encoded([texts_a[k]])[0][0]))
                x, y = held[1], token_set(encoded([texts_b[k]])[0][0])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    good.append(k)
            yield {"a": pa.array([a[k] for k in good], pa.int64()), "b": pa.array([b[k] for k in good], pa.int64())}

    return map_arrow(rows, run, "a bigint, b bigint")


def _alike(x: str, y: str, words: tuple[str, ...]) -> Column:
    """The bitmaps allow the similarity."""
    apart = " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in words)
    return F.expr(f"7 * ({apart}) <= {x}.n + {y}.n")


def _in_reach(x: str, y: str, words: tuple[str, ...]) -> Column:
    """Sizes fit, the match is one of the first l of two sets that share enough, and the bitmaps
    allow it."""
    return F.expr(f"4 * least({x}.n, {y}.n) >= 3 * greatest({x}.n, {y}.n)") & F.expr(
        f"7L * (least({x}.n - {x}.pos, {y}.n - {y}.pos) + least({x}.l, {y}.l) - 1) >= 3L * ({x}.n + {y}.n)") & _alike(
        x, y, words)


def _named(sets: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The classes ``sets(sig, ...)`` with the component c of each."""
    if comp is None:
        return sets.withColumn("c", F.col("sig"))
    return sets.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "c", F.coalesce("component", "sig")).drop("component")


def _open_lists(named: DataFrame) -> DataFrame:
    """Entries of the lists that span two components."""
    spans = named.groupBy("f").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("f")
    return named.join(spans, "f", "left_semi")


def links(entries: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch,
          rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all linked classes, and the verified links (a, b); ``reps`` holds a
    document and the finer bitmap of each class."""
    wanted = scratch.table(reps.join(entries.select("sig").distinct(), "sig", "left_semi"), "wanted")
    texts = scratch.table(texts_of(docs, wanted.select("sig", "rep", "rep_text")), "class-texts")
    comp, tested, found = None, None, None

    def confirm(pairs):
        nonlocal comp, tested, found
        pairs = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        good = scratch.table(verified(pairs, texts), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = good if found is None else found.unionByName(good)
        last, comp = comp, components(good, scratch.table, comp)
        scratch.drop(last)

    # pairs of a list for each of its entries
    long = F.expr(f"(held - 1) / 2 > {FEW_PAIRS}")
    plain = entries.columns
    rows = entries.where(long)
    if rounds and not rows.isEmpty():
        degree = entries.groupBy("sig").agg(F.count("*").alias("degree"))
        sets = scratch.table(degree.join(rows.select("sig").distinct(), "sig", "left_semi").join(
            wanted.select("sig", *folded()), "sig"), "list-classes")
        for k in range(rounds):
            last, named = rows, scratch.table(rows.select(*plain).join(_named(sets, comp), "sig"), "named-lists")
            rows = scratch.table(_open_lists(named), "open-lists")
            scratch.drop(last, named)
            if rows.isEmpty():
                break
            # first the set with the most shared entries, which lies nearest to the middle of its
            # group, then others by hash: each list has its own, so that a set meets many of its group
            rank = F.struct(-F.col("degree"), "sig") if k == 0 else F.struct(F.xxhash64(F.lit(k), "f", "sig"))
            lead = rows.groupBy("f").agg(F.min_by(F.struct("sig", "n", "c", "l", "pos", *WORDS), rank).alias("y"))
            pairs = rows.alias("x").join(lead, "f").where((F.col("x.c") != F.col("y.c")) & _in_reach("x", "y", WORDS))
            confirm(pairs.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct())
        scratch.drop(sets)
    # short lists, and long ones that were open before the last round
    left = entries.where(~long).unionByName(rows.select(*plain)).join(
        _named(wanted.select("sig", *FINE_WORDS), comp), "sig")
    # y is the smaller set, so only its index part takes part
    x, y = left.alias("x"), left.where("pos < n - CAST(ceil(6 * n / 7) AS INT) + l").alias("y")
    confirm(x.join(y, F.col("x.f") == F.col("y.f"))
            .where(F.expr("y.n < x.n OR y.n = x.n AND y.sig < x.sig") & (F.col("x.c") != F.col("y.c"))
                   & _in_reach("x", "y", FINE_WORDS))
            .groupBy(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
            .agg(F.count("*").alias("m"), F.min(F.least("x.l", "y.l")).alias("need"))
            .where("m >= need").select("a", "b"))
    return comp, found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n, sig (class of equal sets), component (of classes), component_id, n_confirmed for
    every row of ``docs(doc_id, text)``, as a stored table; all others of the way are dropped."""
    n_buckets = 2 * buckets_for(docs)
    with Scratch(docs.sparkSession) as scratch:
        profiled = scratch.table(profile(docs, n_buckets), "profile")
        counts = scratch.table(frequent(profiled.where("bucket >= 0").select("bucket", "block"), n_buckets), "frequent")
        heavy = heavy_list(counts)
        rows = scratch.table(profiled.where("bucket = -1").drop("bucket", "block"), "profile-rows")
        scratch.drop(profiled, counts)
        entries = scratch.table(postings(docs, n_buckets, heavy), "postings")
        reps = rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min_by("text_id", "doc_id").alias("rep_text"),
                                       *[F.first(w).alias(w) for w in FINE_WORDS])
        comp, found = links(entries, docs, reps.where("rep IS NOT NULL"), scratch)
        grouped = reps.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
            "component", F.coalesce("component", "sig"))
        least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
        degree = found.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("n_confirmed"))
        named = grouped.join(least, "component").join(degree, "sig", "left").select(
            "sig", "component", "component_id", "n_confirmed")
        return materialise(rows.drop(*FINE_WORDS).join(named, "sig", "left"), "near-duplicates")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class (of equal sets), n_confirmed (links between the class
    and others that were confirmed on the way; links inside a component need not all be) for every
    row of ``docs(doc_id, text)``."""
    empty = F.col("n") == 0
    return classes(docs).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("sig").alias("class"),
        F.when(empty, F.lit(0)).otherwise(F.coalesce("n_confirmed", F.lit(0))).cast("bigint").alias("n_confirmed"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest id of every component, of equal ids the one with the least text
    hash; rows without an id or without shingles stay.  Of rows with equal id and text one stays, the
    first by its JSON form."""
    found = classes(docs)
    linked = found.where("doc_id IS NOT NULL AND n > 0")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("first"))
    gone = linked.join(first, "component").where(F.struct("doc_id", "text_id") != F.col("first")).select(
        F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (text_id() == gone["_text_id"]), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).agg(
        F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if again.isEmpty():
        return kept
    # only rows that are repeated are grouped
    same = kept["doc_id"].eqNullSafe(again["_id"]) & (text_id() == again["_text_id"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("_id"), text_id().alias("_text_id")).agg(
        F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
