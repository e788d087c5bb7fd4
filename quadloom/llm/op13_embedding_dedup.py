"""Near-duplicate vectors by an exact metric range join.

1. Equal vectors become one class (the direction counts, so vectors are scaled to length one); the
   join runs on classes and counts a class as often as it occurs.
2. Pivots come from a bounded sample: the means of its densest neighbourhoods, then sample vectors far
   from all pivots chosen so far.  Every vector belongs to the cell of its nearest pivot.
3. Vectors at a distance ``eps`` (Euclidean, on the unit sphere) must meet.  By the triangle
   inequality a vector x of cell p can have a partner in cell q only if
   d(x, q) - d(x, p) <= 2 eps, and only if d(x, q) lies within ``eps`` of the distances that the
   vectors of cell q have to their pivot.  Such vectors are copied to q; of two cells one copies to
   the other, so a pair meets once.
4. Cells are cut into chunks and joined independently, one pair of chunks a task row: products in
   single precision, and all pairs within its error of the threshold again in double precision.
   Vectors at most eps / 2 from one pivot are partners without a product.  A chunk pair gives counts
   and a spanning forest of its links, never its pairs.

The join is exact for any data.  How much it prunes depends on the data: where distances to all
pivots are alike (independent directions in many dimensions), most vectors border on most cells, and
the work is that of all pairs, cut into equal pieces.

A vector is ignored (no links, a component of its own) if it is NULL, empty or zero, or holds NULL or
non-finite components.  Vectors of different length never link.  Rows that share a vec_id are vectors
of their own; a NULL vec_id is last in order, and such a row is kept only if all its component lacks
ids: never.  Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .components import components

SIMILAR = 0.95
SAMPLE = 4096  # vectors the pivots are chosen from, whatever the size of the table
CHUNK = 16_384  # vectors of a cell that meet in one piece of work
BLOCK = 1024  # rows of one product
MARGIN = 1e-6  # distances are compared with this much to spare


# ---------------------------------------------------------------- classes
def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``(vec_id, key)`` and classes ``(key, node, size, dims, v)``; ``v`` holds unit
    vectors as bytes of doubles.  A NULL key marks rows that link with nothing."""
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists(e, lambda x: x != 0), F.lit(False))
    # adding 0.0 makes -0.0 and 0.0 the same bytes
    key = F.when(sound, F.sha2(F.concat_ws(",", F.transform(e, lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    rows = materialise(vectors.select("vec_id", key.alias("key"), F.when(sound, e).alias("e")), "vectors")

    def unit(batches):
        for batch in batches:
            out = []
            for x in batch.column("e"):
                x = np.array(x.as_py(), np.float64)
                x /= np.abs(x).max()  # keeps squares finite
                out.append(x / np.sqrt(x @ x))
            yield {"key": batch.column("key"), "size": batch.column("size"),
                   "dims": pa.array([len(x) for x in out], pa.int32()),
                   "v": pa.array([x.tobytes() for x in out], pa.binary())}

    one = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("size"), F.first("e").alias("e"))
    made = map_arrow(one, unit, "key string, size bigint, dims int, v binary")
    return rows.select("vec_id", "key"), materialise(made.withColumn("node", F.monotonically_increasing_id()), "classes")


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(-1, dims)


# ---------------------------------------------------------------- pivots and cells
def choose_pivots(sample: np.ndarray, n: int, eps: float) -> np.ndarray:
    """``n`` unit vectors: means of dense neighbourhoods, then the farthest sample vectors."""
    near = sample @ sample.T >= 1 - eps * eps / 2
    weight = near.sum(axis=1)
    free = np.ones(len(sample), bool)
    out: list[np.ndarray] = []
    for i in np.argsort(-weight, kind="stable"):
        if weight[i] < 3 or len(out) >= n // 2:
            break
        if free[i]:
            mean = sample[near[i]].mean(axis=0)
            out.append(mean / np.linalg.norm(mean))
            free[near[i]] = False
    if not out:
        out.append(sample[0])
    closest = np.max(sample @ np.array(out).T, axis=1)
    while len(out) < min(n, len(sample)):
        i = int(np.argmin(closest))
        out.append(sample[i])
        closest = np.maximum(closest, sample @ sample[i])
    return np.array(out)


@dataclass
class Cells:
    """Pivots of one dimension, and what is known of each cell."""

    pivots: np.ndarray
    eps: float
    chunks: np.ndarray | None = None
    nearest: np.ndarray | None = None
    farthest: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ self.pivots.T), 0))

    def visits(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Cells each vector is copied to: those it may have a partner in and that do not copy to it."""
        own = d[np.arange(len(d)), home][:, None]
        spare = self.eps + MARGIN
        near = (d - own <= 2 * spare) & (d <= self.farthest + spare) & (d >= self.nearest - spare)
        q = np.arange(d.shape[1])
        p = home[:, None]
        guest = (p != q) & ((p < q) == ((p + q) % 2 == 0))
        return near & guest


def _survey(batches, cells: dict[int, Cells]):
    """Per cell the number of vectors and the range of their distances."""
    for dims, x, _ in _by_dims(batches):
        d = cells[dims].distances(x)
        home = d.argmin(axis=1)
        own = d[np.arange(len(d)), home]
        cell = np.unique(home)
        yield {"dims": pa.array([dims] * len(cell), pa.int32()), "cell": pa.array(cell, pa.int32()),
               "n": [int((home == c).sum()) for c in cell], "low": [float(own[home == c].min()) for c in cell],
               "high": [float(own[home == c].max()) for c in cell]}


def _by_dims(batches):
    for batch in batches:
        dims = batch.column("dims").to_numpy(zero_copy_only=False)
        for k in np.unique(dims):
            part = batch.filter(pa.array(dims == k))
            yield int(k), _matrix(part.column("v"), int(k)), part


def _deal(batches, cells: dict[int, Cells]):
    """Blocks of vectors for each pair of chunks ``a <= b`` of a cell.

    A vector of the cell belongs to chunk a and meets chunks a..; a guest meets all chunks of the
    cell but not other guests.
    """
    for dims, x, part in _by_dims(batches):
        of = cells[dims]
        nodes, sizes = part.column("node").to_numpy(), part.column("size").to_numpy()
        d = of.distances(x)
        home = d.argmin(axis=1)
        visits = of.visits(d, home)
        out = {k: [] for k in ("dims", "cell", "a", "b", "side", "ids", "sizes", "core", "v")}

        def add(cell, a, b, side, at, core):
            for key, value in (("dims", dims), ("cell", cell), ("a", a), ("b", b), ("side", side),
                               ("ids", nodes[at].astype("<i8").tobytes()), ("sizes", sizes[at].astype("<i8").tobytes()),
                               ("core", core.tobytes()), ("v", x[at].tobytes())):
                out[key].append(value)

        for cell in range(d.shape[1]):
            n = int(of.chunks[cell])
            at = np.flatnonzero(home == cell)
            core = d[at, cell] <= of.eps / 2 - MARGIN
            chunk = nodes[at] % n
            for c in np.unique(chunk):
                own = chunk == c
                for other in range(n):
                    a, b = min(c, other), max(c, other)
                    add(cell, a, b, int(c == b and a != b), at[own], core[own])
            at = np.flatnonzero(visits[:, cell])
            if len(at):
                for c in range(n):
                    add(cell, c, c, 2, at, np.zeros(len(at), bool))
        yield {k: pa.array(v, {"dims": pa.int32(), "cell": pa.int32(), "a": pa.int32(), "b": pa.int32(),
                               "side": pa.int8()}.get(k, pa.binary())) for k, v in out.items()}


# ---------------------------------------------------------------- one piece of work
class Forest:
    """Trees over the vectors of one piece; only links between trees are remembered."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _similar(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, least: float) -> np.ndarray:
    """Mask of the pairs with a product of ``least`` or more: single precision decides all but those
    within its error, which are multiplied in double precision."""
    error = np.float32((x.shape[1] + 8) * 1.3e-7)
    product = xs @ ys.T
    mask = product >= np.float32(least) + error
    i, j = np.nonzero((product >= np.float32(least) - error) & ~mask)
    for s in range(0, len(i), 1 << 16):
        p, q = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        mask[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= least
    return mask


def join_chunks(least: float):
    """One pair of chunks with its guests: (node, links, root) of every vector with a link."""

    def load(table: pa.Table, side: int, dims: int):
        rows = table.filter(pa.compute.equal(table["side"], side))
        blob = lambda c: b"".join(x.as_py() for x in rows[c])
        return (np.frombuffer(blob("ids"), "<i8"), np.frombuffer(blob("sizes"), "<i8"),
                np.frombuffer(blob("core"), bool), np.frombuffer(blob("v"), np.float64).reshape(-1, dims))

    def run(key, table):
        dims, _, a, b = (k.as_py() for k in key)
        left, right, guests = (load(table, side, dims) for side in (0, 1, 2))
        ids = np.concatenate([left[0], right[0], guests[0]])
        sizes = np.concatenate([left[1], right[1], guests[1]])
        core = np.concatenate([left[2], right[2], guests[2]])
        x = np.concatenate([left[3], right[3], guests[3]])
        xs = x.astype(np.float32)
        n, m = len(left[0]), len(left[0]) + len(right[0])
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))

        def compare(p: np.ndarray, q: np.ndarray, same: bool):
            """All pairs of rows p and q; ``same``: pairs of one list, each met once from either end."""
            if not len(q):
                return
            for s in range(0, len(p), BLOCK):
                rows = p[s:s + BLOCK]
                mask = _similar(x[rows], x[q], xs[rows], xs[q], least)
                if same:
                    mask &= rows[:, None] != q
                i, j = np.nonzero(mask)
                i, j = rows[i], q[j]
                np.add.at(links, i, sizes[j])
                if not same:
                    np.add.at(links, j, sizes[i])
                forest.join(i, j)

        def sure(p: np.ndarray, q: np.ndarray):
            """All of p are partners of all of q; p and q may be the same list."""
            if len(p) and len(q):
                same = p is q
                links[p] += sizes[q].sum() - (sizes[p] if same else 0)
                if not same:
                    links[q] += sizes[p].sum()
                forest.join(p, np.full(len(p), q[0]))
                forest.join(q, np.full(len(q), p[0]))

        first = np.arange(n)
        if a == b:
            mid, shell = first[core[:n]], first[~core[:n]]
            sure(mid, mid)
            compare(shell, shell, True)
            compare(shell, mid, False)
            compare(np.arange(m, len(ids)), first, False)
        else:
            second = np.arange(n, m)
            mid, shell = first[core[:n]], first[~core[:n]]
            mid2, shell2 = second[core[n:m]], second[~core[n:m]]
            sure(mid, mid2)
            compare(shell, second, False)
            compare(mid, shell2, False)
        at = np.flatnonzero(links)
        return pa.table({"node": ids[at], "links": links[at], "root": ids[forest.root[at]]})

    return run


# ---------------------------------------------------------------- the join
def _cells(made: DataFrame, eps: float, chunk: int, pivots: int | None) -> dict[int, Cells]:
    """Pivots from a bounded sample, then the size and the distance range of every cell: one row a
    cell comes to the driver."""
    out = {}
    for row in made.groupBy("dims").agg(F.count("*").alias("n")).collect():
        sample = made.where(F.col("dims") == row.dims).orderBy(F.xxhash64("key")).limit(SAMPLE).select("v").toArrow()
        n = pivots or max(2, round(sqrt(row.n / chunk) * 2))
        out[row.dims] = Cells(choose_pivots(_matrix(sample["v"], row.dims), n, eps), eps)
    known = map_arrow(made.select("dims", "v"), lambda batches: _survey(batches, out),
                      "dims int, cell int, n bigint, low double, high double")
    known = known.groupBy("dims", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    for cells in out.values():
        k = len(cells.pivots)
        cells.chunks, cells.nearest, cells.farthest = np.ones(k, np.int64), np.full(k, 9.0), np.full(k, -9.0)
    for row in known.collect():
        cells = out[row.dims]
        cells.chunks[row.cell] = -(-row.n // chunk)
        cells.nearest[row.cell], cells.farthest[row.cell] = row.low, row.high
    return out


def range_join(made: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK, pivots: int | None = None) -> DataFrame:
    """Stored ``(node, links, root)``: partial link counts and a spanning forest of the links."""
    eps = sqrt(2 - 2 * similar)
    cells = _cells(made, eps, chunk, pivots)
    dealt = map_arrow(made.select("node", "size", "dims", "v"), lambda batches: _deal(batches, cells),
                      "dims int, cell int, a int, b int, side tinyint, ids binary, sizes binary, core binary, v binary")
    found = dealt.groupBy("dims", "cell", "a", "b").applyInArrow(join_chunks(similar), "node bigint, links bigint, root bigint")
    return materialise(found, "links")


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK,
                 pivots: int | None = None) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    rows, made = classes(vectors)
    found = range_join(made, similar, chunk, pivots)
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = made.select("key", "node", "size").join(links, "node", "left").join(linked, "node", "left")
    groups = groups.select("key", F.coalesce("component", "node").alias("component"),
                           (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    marked = rows.where("key is not null").join(groups, "key")
    least = marked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = marked.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
