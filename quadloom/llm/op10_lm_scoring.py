"""Language-model scores from an Elias-Fano n-gram trie.

Two Spark passes count words and word pairs of the training documents in hash buckets; the task of
a bucket writes its part of a trie level to the shared folder.  Level 1 holds word hashes and
counts; a word's place there is its number.  Level 2 holds, for the words of a bucket, the numbers
of their successors: monotone pointers say where the successors of a context begin, and the
successors follow each other as one monotone sequence because each is stored relative to its
context.  Beside each successor stands its smoothed probability in 16 bits.  A third pass maps
the levels into memory and looks up all distinct pairs of a batch at once.

Pairs are smoothed towards words, p(w | c) = (n(c, w) + M p(w)) / (n(c) + M), and words by adding
one.  The first word follows the end token.  Successors are also split by their own number, so a
frequent context is spread over several tasks and files.

Edge cases: a NULL or empty text is the end token alone; unknown words have count 0; rows without an
id are training rows; repeated rows count each; without training rows every word is unknown; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, buckets_for, by_bucket, map_arrow, scratch_path, utf8
from .elias_fano import Sequence, encode, map_arrays, write_arrays
from .packed import FLUSH, gather, pack, splits, unpack

END = b"\n"  # no word contains white space
PARTS = 4  # ways in which the successors of a bucket of contexts are split
PRIOR = 2000.0
STEP = 4096.0  # codes per decade of probability


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _tokens(texts: list[bytes]):
    """Word numbers within the batch of every text followed by the end token, the lengths, and
    the hashes of the batch's words."""
    vocabulary = Vocabulary()
    end = vocabulary.ids[END]
    rows = [np.append(vocabulary.encode(t), end) for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.empty(0, np.int64)), lengths, vocabulary.hashes(), end


class Model:
    """What tasks need to find their way: folder, bucket edges and totals."""

    def __init__(self, path: str, n_buckets: int, words: list[int], total: int):
        self.path, self.n_buckets, self.total = path, n_buckets, total
        self.first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)  # number of a bucket's first word
        self.size = int(self.first[-1])
        self.shards: frozenset = frozenset()  # of level 2 that exist
        self.open: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def level(self, name: str):
        if name not in self.open:
            arrays = map_arrays(f"{self.path}/{name}")
            self.open[name] = (arrays, Sequence(arrays, "keys"))
        return self.open[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of every word hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        at = splits(hashes[order], self.n_buckets, 64)
        for b in range(self.n_buckets):
            which = order[at[b]:at[b + 1]]
            if len(which) and self.first[b] < self.first[b + 1]:
                arrays, keys = self.level(f"words-{b}")
                found = keys.find(hashes[which] - np.uint64((b << 64) // self.n_buckets))
                hit = found >= 0
                number[which[hit]] = found[hit] + self.first[b]
                count[which[hit]] = arrays["count"][found[hit]]
        return number, count

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Stored log10 probability of every known pair, NaN where the trie has none; the
        numbers are sorted by context."""
        out = np.full(len(context), np.nan)
        part = word * PARTS // max(self.size, 1)
        cuts = np.searchsorted(context, self.first)
        for b in range(self.n_buckets):
            for p in range(PARTS):
                which = np.flatnonzero(part[cuts[b]:cuts[b + 1]] == p) + cuts[b]
                if not len(which) or b * PARTS + p not in self.shards:
                    continue
                arrays, keys = self.level(f"pairs-{b}-{p}")
                local = context[which] - self.first[b]
                found = keys.find((local * self.size + word[which]).astype(np.uint64))
                # the successor must lie in the range its context points to
                pointer = arrays["pointer"]
                hit = (found >= pointer[local]) & (found < pointer[local + 1])
                out[which[hit]] = arrays["code"][found[hit]] / -STEP
        return out


def _count_words(docs: DataFrame, path: str, n_buckets: int) -> Model:
    def emit(batches):
        for batch in batches:
            ids, _, hashes, _ = _tokens(batch.column("text").to_pylist())
            count = np.bincount(ids, minlength=len(hashes))
            order = np.argsort(hashes)
            hashes, count = hashes[order], count[order]
            at = splits(hashes, n_buckets, 64)
            parts = [b for b in range(n_buckets) if at[b] < at[b + 1]]
            yield {"bucket": pa.array(parts, pa.int32()),
                   "keys": pa.array([pack(hashes[at[b]:at[b + 1]]) for b in parts], pa.binary()),
                   "counts": pa.array([count[at[b]:at[b + 1]].astype("<u4").tobytes() for b in parts], pa.binary())}

    def store(batches):
        for bucket, rows in gather(batches, ["keys", "counts"]).items():
            keys, count = _merged(rows)
            base, top = (bucket << 64) // n_buckets, ((bucket + 1) << 64) // n_buckets
            write_arrays(f"{path}/words-{bucket}", {**encode(keys - np.uint64(base), top - base, "keys"), "count": count})
            yield {"bucket": pa.array([bucket], pa.int32()), "words": pa.array([len(keys)], pa.int64()),
                   "total": pa.array([int(count.sum())], pa.int64())}

    blocks = map_arrow(docs.select("text"), emit, "bucket int, keys binary, counts binary")
    stored = map_arrow(by_bucket(blocks, n_buckets), store, "bucket int, words bigint, total bigint").collect()
    words = dict.fromkeys(range(n_buckets), 0) | {r.bucket: r.words for r in stored}
    return Model(path, n_buckets, [words[b] for b in range(n_buckets)], sum(r.total for r in stored))


def _merged(rows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several blocks and the sums of their counts."""
    keys = np.concatenate([unpack(k) for k, _ in rows])
    count = np.concatenate([np.frombuffer(c, "<u4") for _, c in rows]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, count = keys[order], count[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(count, start)


def _contexts(number: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Number of the word before each token; the end token before the first of a text."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return before


def _count_pairs(docs: DataFrame, model: Model) -> None:
    n_buckets, sent = model.n_buckets, docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches):
        held, size = [], 0

        def flush():
            m = sent.value
            pairs = np.concatenate(held)
            pairs.sort()
            start = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            count = np.diff(np.append(start, len(pairs)))
            pairs = pairs[start]
            context, word = np.divmod(pairs, np.uint64(m.size))
            bucket = np.searchsorted(m.first, context.astype(np.int64), side="right") - 1
            shard = bucket * PARTS + (word.astype(np.int64) * PARTS // m.size)
            order = np.argsort(shard, kind="stable")
            pairs, count, shard = pairs[order], count[order], shard[order]
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            cuts = list(zip(at, np.append(at[1:], len(shard))))
            return {"bucket": pa.array(shard[at].astype(np.int32)),
                    "keys": pa.array([pack(pairs[i:j]) for i, j in cuts], pa.binary()),
                    "counts": pa.array([count[i:j].astype("<u4").tobytes() for i, j in cuts], pa.binary())}

        for batch in batches:
            ids, lengths, hashes, end = _tokens(batch.column("text").to_pylist())
            if not len(ids):
                continue
            number = sent.value.words(hashes)[0]
            words = number[ids]
            held.append((_contexts(words, lengths, number[end]) * sent.value.size + words).astype(np.uint64))
            size += len(words)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def store(batches):
        m = sent.value
        for shard, rows in gather(batches, ["keys", "counts"]).items():
            keys, count = _merged(rows)
            b = shard // PARTS
            context, word = (x.astype(np.int64) for x in np.divmod(keys, np.uint64(m.size)))
            local, span = context - m.first[b], int(m.first[b + 1] - m.first[b])
            level = m.level(f"words-{b}")[0]["count"]
            # the words' own counts: successors come from every bucket
            own = _counts_of(m, word)
            p = (count + PRIOR * (own + 1) / (m.total + m.size + 1)) / (level[local] + PRIOR)
            code = np.minimum(np.round(-np.log10(p) * STEP), 65535).astype("<u2")
            pointer = np.searchsorted(local, np.arange(span + 1)).astype(np.int64)
            write_arrays(f"{m.path}/pairs-{shard // PARTS}-{shard % PARTS}", {
                **encode((local * m.size + word).astype(np.uint64), max(1, span * m.size), "keys"),
                "pointer": pointer, "code": code})
            yield {"bucket": pa.array([shard], pa.int32()), "pairs": pa.array([len(keys)], pa.int64())}

    blocks = map_arrow(docs.select("text"), emit, "bucket int, keys binary, counts binary")
    stored = map_arrow(by_bucket(blocks, n_buckets * PARTS), store, "bucket int, pairs bigint").collect()
    model.shards = frozenset(r.bucket for r in stored)


def _counts_of(m: Model, number: np.ndarray) -> np.ndarray:
    out = np.empty(len(number), np.int64)
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], m.first)
    for b in range(m.n_buckets):
        which = order[cuts[b]:cuts[b + 1]]
        if len(which):
            out[which] = m.level(f"words-{b}")[0]["count"][number[which] - m.first[b]]
    return out


def train(docs: DataFrame) -> Model:
    """A model of ``docs(text)``, text as bytes, stored in the shared folder."""
    path = scratch_path(docs.sparkSession, "lm")
    from .op4_warc import filesystem

    files, where = filesystem(path)
    files.create_dir(where, recursive=True)
    model = _count_words(docs, path, buckets_for(docs))
    if model.size:
        _count_pairs(docs, model)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of
    ``docs(doc_id, text, held_out)``, text as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = sent.value
            ids, lengths, hashes, end = _tokens(batch.column("text").to_pylist())
            if not len(lengths):
                continue
            number, count = m.words(hashes)
            base = np.log10((count + 1) / (m.total + m.size + 1))
            starts = np.cumsum(lengths) - lengths
            per_text = lambda x: np.add.reduceat(x[ids], starts)
            # distinct pairs of the batch, by number of the context within the batch
            before = _contexts(ids, lengths, end)
            pairs, back = np.unique(before * len(hashes) + ids, return_inverse=True)
            context, word = np.divmod(pairs, len(hashes))
            p = np.log10((PRIOR * 10.0 ** base[word]) / (count[context] + PRIOR))
            known = np.flatnonzero((number[context] >= 0) & (number[word] >= 0))
            known = known[np.argsort(number[context[known]], kind="stable")]
            if len(known):
                stored = m.pairs(number[context[known]], number[word[known]])
                seen = ~np.isnan(stored)
                p[known[seen]] = stored[seen]
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": lengths,
                   "n_known": per_text((count > 0).astype(np.int64)),
                   "train_tokens": np.full(len(lengths), m.total, np.int64),
                   "base_score": per_text(base), "score": np.add.reduceat(p[back], starts)}

    return map_arrow(docs, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                "train_tokens bigint, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """The rows of the registered query: trained on the rows that are not held out."""
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    return score_documents(rows, train(rows.where(~F.col("held_out"))))
