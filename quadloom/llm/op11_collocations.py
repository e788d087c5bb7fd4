"""Phrase collocations by Rabin-Karp fingerprints.

1. Lower-cased texts are packed into blocks of one language, a piece (text between punctuation
   marks or line breaks) to a line, and stored.
2. Every block hashes all its runs of 1 to 4 words with prefix polynomials: one cumulative sum, then
   two look-ups a run.  Distinct fingerprints leave the block once, packed by hash range, with their
   count and the block as pointer to where they occur.
3. Each hash range adds up its counts and answers every block with its share of the fingerprints
   that are frequent in all.
4. The blocks look up only those runs in their text and send the words themselves, so two phrases
   of one fingerprint are told apart: counts come from the text, fingerprints merely leave out what
   cannot be frequent.

NULL texts are empty, a NULL language is ``und``; repeated rows count each.  A text longer than a
block is cut between pieces only.  Empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_arrow, materialise, mixed, utf8
from .packed import pack, unpack

LONGEST = 4
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20  # of text for each hash range; its fingerprints take about five times as much
BASE = 0x9E3779B97F4A7C15 | 1
BITS = 48  # of a fingerprint that travel; equal ones of different phrases only cost a second look

# The characters that end a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "\n" * len(ENDS) + " ").encode())


# ---------------------------------------------------------------- blocks
def _cut(held: list[bytes], size: int, whole: bool):
    """Blocks of about ``size`` bytes and the rest; cuts lie between pieces."""
    text = b"\n".join(held)
    while len(text) >= size:
        at = text.rfind(b"\n", 0, size)
        at = at if at > 0 else text.find(b"\n", size)
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1:]
    if whole or len(text) >= size:
        yield text
        text = b""
    held[:] = [text] if text else []


def text_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Stored ``(block, lang, text, n_words)``: lower-cased pieces, one a line."""

    def run(batches):
        held, sizes = defaultdict(list), defaultdict(int)
        first = TaskContext.get().partitionId() << 32
        number = count(first)

        def out(lang, whole):
            for text in _cut(held[lang], size, whole):
                words = len(text.split())
                if words:
                    yield {"block": [next(number)], "lang": [lang], "text": pa.array([text], pa.binary()),
                           "n_words": [words]}
            sizes[lang] = sum(map(len, held[lang]))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py().translate(PLAIN)
                held[lang].append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= size:
                    yield from out(lang, False)
        for lang in list(held):
            yield from out(lang, True)

    rows = docs.select(utf8(F.col("text")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return materialise(map_arrow(rows, run, "block bigint, lang string, text binary, n_words bigint"), "blocks")


# ---------------------------------------------------------------- fingerprints
def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers in text order, the piece of each, and the words."""
    numbers = defaultdict(count().__next__)
    numbers[b""], numbers[b"\n"]
    found = text.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    ids = ids[ids > 0]
    piece = np.cumsum(ids == 1)
    word = ids > 1
    return ids[word] - 2, piece[word], list(numbers)[2:]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def fingerprints(ids: np.ndarray, piece: np.ndarray, words: list[bytes], lang: str):
    """For each length the positions of all runs inside a piece and their fingerprints."""
    digest = xxhash.xxh3_64_intdigest
    symbol = np.fromiter(map(digest, words), np.uint64, len(words))[ids]
    # prefix[i] = sum of symbol[j] * BASE^j for j < i, modulo 2^64; an odd base has an inverse there
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbol * _powers(BASE, len(ids)), dtype=np.uint64)])
    back = _powers(pow(BASE, -1, 2**64), len(ids))
    for n in range(1, LONGEST + 1):
        m = max(len(ids) - n + 1, 0)
        at = np.flatnonzero(piece[n - 1:] == piece[:m])
        seed = np.uint64(digest(f"{n} {lang}".encode()))
        yield n, at, mixed((prefix[at + n] - prefix[at]) * back[at] + seed) >> np.uint64(64 - BITS)


def _distinct(text: bytes, lang: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [fp for _, _, fp in fingerprints(*tokens(text), lang)]
    return np.unique(np.concatenate(parts), return_counts=True)


def _partial(batches, buckets: int, least: int):
    edges = np.array([(k << BITS) // buckets for k in range(1, buckets)], np.uint64)
    for batch in batches:
        for block, lang, text in zip(*(batch.column(c) for c in ("block", "lang", "text"))):
            keys, counts = _distinct(text.as_py(), lang.as_py())
            counts = np.minimum(counts, least).astype("<u4")
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            full = np.flatnonzero(np.diff(cuts))
            yield {"bucket": pa.array(full, pa.int32()), "block": [block.as_py()] * len(full),
                   "keys": pa.array([pack(keys[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
                   "counts": pa.array([counts[cuts[b]:cuts[b + 1]].view(np.uint8).reshape(-1, 4).T.tobytes()
                                       for b in full], pa.binary())}


def _planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _answers(least: int):
    """One hash range: which of its fingerprints are frequent, told to each block that has them."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        keys = [unpack(x.as_py()) for x in table.column("keys")]
        every = np.concatenate(keys)
        order = np.argsort(every)
        every = every[order]
        counts = np.concatenate([_planes(x.as_py()) for x in table.column("counts")]).astype(np.int64)[order]
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        frequent = every[start][np.add.reduceat(counts, start) >= least]
        out = []
        for block, own in zip(blocks, keys):
            if len(frequent):
                own = own[frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own]
                if len(own):
                    out.append((block, pack(own)))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "keys": pa.array([k for _, k in out], pa.binary())})

    return run


# ---------------------------------------------------------------- phrases
def _same_words(ids: np.ndarray, n: int, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    same = np.ones(len(at), bool)
    for k in range(n):
        same &= ids[at + k] == ids[first + k]
    return same


def block_phrases(text: bytes, lang: str, frequent: np.ndarray) -> dict[bytes, int]:
    """Counts of the phrases of a block whose fingerprints are listed (sorted), from its words."""
    ids, piece, words = tokens(text)
    out: dict[bytes, int] = defaultdict(int)
    for n, at, fp in fingerprints(ids, piece, words, lang):
        if not len(frequent) or not len(at):
            continue
        slot = np.minimum(np.searchsorted(frequent, fp), len(frequent) - 1)
        hit = frequent[slot] == fp
        at, slot = at[hit], slot[hit]
        first = np.full(len(frequent), -1, np.int64)
        first[slot[::-1]] = at[::-1]
        same = _same_words(ids, n, at, first[slot])
        counts = np.bincount(slot[same], minlength=len(frequent))
        for s in np.flatnonzero(counts):
            out[b" ".join([words[i] for i in ids[first[s]:first[s] + n]])] += int(counts[s])
        for p in at[~same]:  # another phrase of the same fingerprint
            out[b" ".join([words[i] for i in ids[p:p + n]])] += 1
    return out


def _phrases(key, left: pa.Table, right: pa.Table) -> pa.Table:
    counts: dict[bytes, int] = {}
    lang = ""
    if left.num_rows and right.num_rows:
        lang = left.column("lang")[0].as_py()
        keys = np.sort(np.concatenate([unpack(x.as_py()) for x in right.column("keys")]))
        counts = block_phrases(left.column("text")[0].as_py(), lang, keys)
    phrases = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": phrases,
                     "f": pa.array(list(counts.values()), pa.int64())})


def frequent_phrases(blocks: DataFrame, least: int = 30, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Stored ``(lang, phrase, words, f)``: all runs of 1 to 4 words that occur ``least`` times."""
    spark = blocks.sparkSession
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes + 1)
    partial = map_arrow(blocks.select("block", "lang", "text"), lambda batches: _partial(batches, buckets, least),
                        "bucket int, block bigint, keys binary, counts binary")
    answers = partial.groupBy("bucket").applyInArrow(_answers(least), "block bigint, keys binary")
    found = (blocks.select("block", "lang", "text").groupBy("block").cogroup(answers.groupBy("block"))
             .applyInArrow(_phrases, "lang string, phrase string, f bigint"))
    total = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialise(total.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "phrases")


def _exact(c: str):
    return F.col(c).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates of two words or more with their weakest cut: ``(lang, phrase, words, a, l, r, score)``."""
    word = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), word.alias("w"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k",
                       F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).select(
        "lang", "phrase", "words", "a", "k", "l", "r", _exact("a").alias("xa"),
        (_exact("l") + _exact("r")).alias("both"))
    score = F.expr("(xa * cast(2000000 as decimal(7,0))) div both")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(worst).select(
        "lang", "phrase", "words", "a", "worst.l", "worst.r", "worst.score")


def inner_phrases(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, f)``: the highest count of a longer phrase around each shorter one."""
    word = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", "words", "f", word.alias("w"))
    sizes = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    places = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = places.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000,
                 block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out if a longer one around it has at least ``share`` per cent of its count.
    Equal scores are ordered by count, then by the bytes of the phrase.
    """
    blocks = text_blocks(docs, block_bytes)
    phrases = frequent_phrases(blocks, least, bucket_bytes)
    n = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    kept = scored(phrases).join(inner_phrases(phrases), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * share))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
