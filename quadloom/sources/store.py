"""The stored quad table: one row per quad with the sources that hold it, in layers.

``<store>/data/<layer>`` holds Parquet files sorted by predicate and subject.  The first layer of a
state is its base; every refresh or update adds a layer of the quads it changed, each with its whole
new owner set, an empty set being a tombstone.  A reader takes the latest row of each quad: the base
without the quads of the layers above it, and these.  Layers stay small against the base (they are
merged into a new base when they grow), so the base is never shuffled to be read.

``<store>/loads`` has one small row per finished load naming its layers.  It is written after the
data, so a load that dies leaves the previous state; ``<store>/claims`` keeps two loads that began
from the same state from both being committed.

An owner is a position in the source catalog; ``UPDATES`` owns quads inserted by updates.  A refresh
replaces what the files of its sources say and leaves the rest, inserted quads included; a deleted
quad comes back only with a source that is read again.  Which of a source's files a quad came from is
not stored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import construct, distinct_quads
from ..session import materialise
from ..terms import QUADS
from .identity import input_hash, load_decision, manifest_diff
from .readers import read_quads

QUAD = ["g", "s", "s_kind", "p", "o"]
LOADS = "load_id bigint, input_hash string, layers array<string>, rows array<bigint>, at timestamp"
CLAIMS = "load_id bigint, token string, at timestamp"
OWNED = [*QUAD, "owners"]
OWNED_SCHEMA = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in QUADS if f.name in QUAD) + ", owners array<int>"
UPDATES = -1
WORD = 62  # owners kept in one 64-bit number while they are gathered

#: Layers are merged into a new base when they hold this share of its rows, or are this many.
MERGE_SHARE, MERGE_LAYERS = 0.1, 8
#: A claim older than this whose load was never finished no longer stands in the way.
CLAIM_SECONDS = 900


class ConcurrentLoad(RuntimeError):
    """Another load was committed, or is being committed, from the same state."""


# ---------------------------------------------------------------- states
def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of small rows, empty while it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def current_load(spark: SparkSession, store: str):
    """The last finished load, or None."""
    return _stored(spark, f"{store}/loads", LOADS).orderBy(F.desc("load_id")).first()


def decision(spark: SparkSession, store: str, wanted_hash: str) -> str:
    last = current_load(spark, store)
    return load_decision(last and last["input_hash"], wanted_hash, last is not None)


def _append(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    frame = spark.createDataFrame([row], schema.rsplit(",", 1)[0])
    frame.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def _commit(spark: SparkSession, store: str, parent, stamp: str, layers: list[str], rows: list[int]) -> int:
    """Make ``layers`` the current state if ``parent`` still is; returns the load id.

    A load writes its claim, then looks: whoever sees the claim of another for the same id gives
    way.  Two that look at the same time both give way, so never both are committed.
    """
    before = parent["load_id"] if parent else 0
    recent = F.col("at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(CLAIM_SECONDS))
    stale = _stored(spark, f"{store}/claims", CLAIMS).where((F.col("load_id") > before) & ~recent)
    load_id = max(before, stale.agg(F.max("load_id")).first()[0] or 0) + 1
    token = uuid.uuid4().hex
    _append(spark, f"{store}/claims", (load_id, token), CLAIMS)
    others = _stored(spark, f"{store}/claims", CLAIMS).where(
        (F.col("load_id") > before) & (F.col("token") != token) & recent)
    last = current_load(spark, store)
    if (last["load_id"] if last else 0) != before or not others.isEmpty():
        raise ConcurrentLoad(f"{store}: load {before} is no longer the last one, or another load is under way")
    _append(spark, f"{store}/loads", (load_id, stamp, layers, rows), LOADS)
    return load_id


# ---------------------------------------------------------------- owner sets
def _same_quad(left: str = "a", right: str = "b") -> Column:
    """Equal quads of two aliased tables; the default graph equals itself."""
    def pair(c):
        return F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
    out = pair("g")[0].eqNullSafe(pair("g")[1])
    for c in QUAD[1:]:
        out = out & (pair(c)[0] == pair(c)[1])
    return out


def owned(quads: DataFrame, sources: int | None = None) -> DataFrame:
    """One row per quad with its owners in order; rows without a source belong to updates.

    While they are gathered the owners are bits of a few numbers, so the aggregation keeps a
    small state of fixed size.  ``sources`` bounds the source positions (counted when omitted).
    """
    if sources is None:
        sources = (quads.agg(F.max("source_idx")).first()[0] or 0) + 1
    slot = f"(coalesce(source_idx, {UPDATES}) - ({UPDATES}))"
    words, parts = [], []
    for w, low in enumerate(range(UPDATES, sources, WORD)):
        high = min(low + WORD, sources) - 1
        words.append(F.expr(f"bit_or(CASE WHEN {slot} div {WORD} = {w} THEN shiftleft(1L, int({slot} % {WORD}))"
                            f" ELSE 0L END) AS w{w}"))
        parts.append(F.expr(f"CASE WHEN bit_count(w{w}) = 1 THEN array(int(round(log2(w{w}))) + ({low})) ELSE"
                            f" filter(sequence({low}, {high}), x -> w{w} & shiftleft(1L, x - ({low})) <> 0) END"))
    bits = quads.groupBy(*QUAD).agg(*words)
    return bits.select(*QUAD, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("owners"))


def _write(rows: DataFrame, store: str) -> tuple[str, int]:
    """A layer, range partitioned by predicate, subject and object: row groups can be skipped by
    predicate, and a frequent predicate or a hub subject spans many files."""
    layer = uuid.uuid4().hex
    folder = f"{store}/data/{layer}"
    (rows.select(*OWNED).repartitionByRange("p", "s", F.col("o")["value"])
     .sortWithinPartitions("p", "s").write.parquet(folder))
    return layer, rows.sparkSession.read.schema(OWNED_SCHEMA).parquet(folder).count()


def _layer(spark: SparkSession, store: str, layer: str) -> DataFrame:
    return spark.read.schema(OWNED_SCHEMA).parquet(f"{store}/data/{layer}")


def _latest(spark: SparkSession, store: str, layers: list[str]) -> DataFrame:
    """The last row of every quad of the layers above the base."""
    frames = [_layer(spark, store, x).withColumn("layer", F.lit(i)) for i, x in enumerate(layers)]
    if len(frames) == 1:
        return frames[0].drop("layer")
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.groupBy(*QUAD).agg(F.max_by("owners", "layer").alias("owners"))


def _state(spark: SparkSession, store: str, load) -> DataFrame:
    """``OWNED`` rows of a state: no shuffle of the base, and none at all without layers."""
    if not load["layers"]:
        return spark.createDataFrame([], OWNED_SCHEMA)
    base = _layer(spark, store, load["layers"][0])
    if len(load["layers"]) == 1:
        return base
    latest = _latest(spark, store, load["layers"][1:])
    kept = base.alias("a").join(latest.select(*QUAD).alias("b"), _same_quad(), "left_anti")
    return kept.unionByName(latest.where(F.size("owners") > 0))


def _last(spark: SparkSession, store: str):
    last = current_load(spark, store)
    if last is None:
        raise ValueError(f"no finished load in {store}")
    return last


def read_owners(spark: SparkSession, store: str) -> DataFrame:
    """The quads of the current state with ``owners``, the sources that hold each."""
    return _state(spark, store, _last(spark, store))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The set of quads of the current state; ``source_idx`` is the first source of each (NULL if
    only updates hold it)."""
    first = F.col("owners")[0]
    return read_owners(spark, store).select(
        *QUAD, F.when(first != UPDATES, first).alias("source_idx"), F.lit(None).cast("int").alias("file_idx"))


# ---------------------------------------------------------------- loads
def reload_quads(quads: DataFrame, store: str, stamp: str = "", sources: int | None = None) -> int:
    """Replace the whole table by a new base; returns its load id."""
    spark = quads.sparkSession
    parent = current_load(spark, store)
    layer, n = _write(owned(quads, sources), store)
    return _commit(spark, store, parent, stamp, [layer], [n])


def _count(manifest: DataFrame) -> int:
    return (manifest.agg(F.max("source_idx")).first()[0] or 0) + 1


def load_quads(spark: SparkSession, manifest: DataFrame, store: str) -> str:
    """Load a manifest unless the store already holds exactly this input."""
    wanted = input_hash(manifest)
    choice = decision(spark, store, wanted)
    if choice != "keep":
        reload_quads(read_quads(spark, manifest), store, wanted, _count(manifest))
    return choice


def _add_layer(spark: SparkSession, store: str, parent, changed: DataFrame, stamp: str) -> int:
    """Commit the changed quads as a layer, merging all layers when they have grown."""
    layer, n = _write(changed, store)
    layers, rows = [*parent["layers"], layer], [*parent["rows"], n]
    if not n:
        layers, rows = parent["layers"], parent["rows"]
    load_id = _commit(spark, store, parent, stamp, list(layers), list(rows))
    if len(layers) > MERGE_LAYERS or sum(rows[1:]) > MERGE_SHARE * max(sum(rows[:1]), 1):
        load_id = compact(spark, store)
    return load_id


def compact(spark: SparkSession, store: str) -> int:
    """Merge all layers into a new base with the same quads and owners."""
    last = _last(spark, store)
    if len(last["layers"]) < 2:
        return last["load_id"]
    layer, n = _write(_state(spark, store, last), store)
    return _commit(spark, store, last, last["input_hash"], [layer], [n])


def _touched(old: DataFrame, new: DataFrame) -> set[int]:
    """Sources with an added, removed or changed file, or with a file at another position."""
    diff = manifest_diff(old, new).filter("change <> 'same'")
    keys = ["path", "graph", "format"]

    def holders(manifest: DataFrame) -> set[int]:
        a = manifest.select("source_idx", *keys)
        b = diff.select(*[F.col(k).alias(f"__{k}") for k in keys])
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        hit = a.join(b, on[0] & on[1] & on[2], "left_semi")
        return {r["source_idx"] for r in hit.select("source_idx").distinct().collect()}

    # positions are part of blank node names, so a moved file counts as touched
    place = ["source_idx", "file_idx", "path"]
    moved = new.select(*place).exceptAll(old.select(*place))
    gone = old.select(*place).exceptAll(new.select(*place))
    out = holders(old) | holders(new)
    for frame in (moved, gone):
        out |= {r["source_idx"] for r in frame.select("source_idx").distinct().collect()}
    return out


def refresh_quads(spark: SparkSession, old: DataFrame, new: DataFrame, store: str) -> list[int]:
    """Parse again only sources with an added, removed or changed file.

    Their share of the owner sets is replaced: quads that change owners become a layer, all
    others stay where they are.  Returns the sources parsed.
    """
    last = _last(spark, store)
    stale = _touched(old, new)
    present = {r["source_idx"] for r in new.select("source_idx").distinct().collect()}
    redo = sorted(stale & present)
    state = _state(spark, store, last)
    stale_set = F.array(*[F.lit(k) for k in sorted(stale)]).cast("array<int>")
    files = new.filter(F.col("source_idx").isin(redo))
    fresh = owned(read_quads(spark, files), _count(new)) if redo else spark.createDataFrame([], OWNED_SCHEMA)
    fresh = materialise(fresh, "fresh-quads")
    mark = fresh.select(*QUAD, F.lit(True).alias("mark"))
    near = state.alias("a").join(mark.alias("b"), _same_quad(), "left").select(
        *[F.col(f"a.{c}").alias(c) for c in OWNED], "mark")
    # all rows that can change: held by a stale source, or found again in one
    near = materialise(near.where(F.col("mark") | F.arrays_overlap("owners", stale_set)).drop("mark"), "near-quads")
    both = near.alias("a").join(fresh.alias("b"), _same_quad(), "full_outer").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in QUAD],
        F.col("a.owners").alias("was"), F.col("b.owners").alias("found"))
    none = F.array().cast("array<int>")
    was, found = F.coalesce("was", none), F.coalesce("found", none)
    now = F.array_sort(F.array_union(F.array_except(was, stale_set), found))
    changed = both.select(*QUAD, now.alias("owners"), was.alias("was")).where(~F.col("owners").eqNullSafe(F.col("was")))
    _add_layer(spark, store, last, changed, input_hash(new))
    return redo


# ---------------------------------------------------------------- stored updates
def apply_update(spark: SparkSession, store: str, delete: DataFrame | None = None,
                 insert: DataFrame | None = None) -> int:
    """Delete, then insert quads ``(g, s, s_kind, p, o)`` in the stored table; returns the load id.

    Only the named quads are looked up.  Deleting a quad that is not there changes nothing, and
    inserting one that is there adds updates to its owners.
    """
    last = _last(spark, store)
    none = F.array().cast("array<int>")
    named = [frame.select(*QUAD, F.lit(gone).alias("gone"), F.lit(not gone).alias("new"))
             for frame, gone in ((delete, True), (insert, False)) if frame is not None]
    if not named:
        return last["load_id"]
    asked = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    asked = materialise(asked.groupBy(*QUAD).agg(F.max("gone").alias("gone"), F.max("new").alias("new")), "update")
    held = _state(spark, store, last).alias("a").join(asked.select(*QUAD).alias("b"), _same_quad(), "left_semi")
    rows = asked.alias("a").join(held.alias("b"), _same_quad(), "left").select(
        *[F.col(f"a.{c}").alias(c) for c in QUAD], "gone", "new", F.coalesce("b.owners", none).alias("was"))
    left = F.when(F.col("gone"), none).otherwise(F.col("was"))
    now = F.when(F.col("new"), F.array_sort(F.array_union(left, F.array(F.lit(UPDATES))))).otherwise(left)
    changed = rows.withColumn("owners", now).where(F.col("owners") != F.col("was"))
    return _add_layer(spark, store, last, changed, last["input_hash"])


def apply_update_where(spark: SparkSession, store: str, bindings: DataFrame, delete: list[tuple],
                       insert: list[tuple], graph: str | None = None) -> int:
    """DELETE/INSERT WHERE on the stored table: both templates are filled from the same solutions."""
    rows = materialise(bindings, "solutions")
    return apply_update(spark, store, _filled(rows, delete, graph) if delete else None,
                        _filled(rows, insert, graph) if insert else None)


# ---------------------------------------------------------------- updates of a table in a plan
def insert_quads(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set union with the quads already there, which keep their source."""
    return quads.unionByName(delete_quads(distinct_quads(new), quads), allowMissingColumns=True)


def delete_quads(quads: DataFrame, old: DataFrame) -> DataFrame:
    return quads.alias("a").join(old.select(*QUAD).alias("b"), _same_quad(), "left_anti")


def _filled(bindings: DataFrame, template: list[tuple], graph: str | None) -> DataFrame:
    made = construct(bindings, template)
    return made.select(F.lit(graph).cast("string").alias("g"), "s", "s_kind", "p", "o")


def update_where(quads: DataFrame, bindings: DataFrame, delete: list[tuple], insert: list[tuple],
                 graph: str | None = None) -> DataFrame:
    """DELETE/INSERT WHERE: both templates are filled from the same solutions."""
    out = quads
    if delete:
        out = delete_quads(out, _filled(bindings, delete, graph))
    if insert:
        out = insert_quads(out, _filled(bindings, insert, graph))
    return out
