"""Published tables, result rows as JSON, and quad text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import BLANK, IRI, LITERAL, XSD_STRING
from .readers import escape


def _flat(df: DataFrame) -> DataFrame:
    """Term columns as their text, the shape text formats can hold."""
    return df.select(*[
        F.col(f.name)["value"].alias(f.name)
        if isinstance(f.dataType, T.StructType) and f.dataType.names == ["kind", "value", "lang", "dt"]
        else F.col(f.name) for f in df.schema.fields])


def publish(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every table under its name; returns where each one is."""
    places = {}
    for name, df in tables.items():
        places[name] = f"{out_dir}/{name}"
        if fmt == "csv":
            # quotes inside a value are doubled, as other CSV readers expect
            _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(places[name])
        elif fmt in ("parquet", "json"):
            df.write.mode("overwrite").format(fmt).save(places[name])
        else:
            raise ValueError(f"unknown format {fmt}")
    return places


def to_bindings_json(bindings: DataFrame) -> Column:
    """One solution as a JSON object; unbound variables are left out."""
    cells = []
    for name in bindings.columns:
        t = F.col(name)
        kind = F.when(t["kind"] == IRI, "uri").when(t["kind"] == BLANK, "bnode").otherwise("literal")
        typed = (t["kind"] == LITERAL) & (t["lang"] == "") & (t["dt"] != XSD_STRING)
        cells.append(F.when(t.isNotNull(), F.struct(
            kind.alias("type"), t["value"].alias("value"),
            F.when(t["lang"] != "", t["lang"]).alias("xml:lang"),
            F.when(typed, t["dt"]).alias("datatype"))).alias(name))
    return F.to_json(F.struct(*cells))


def term_text(t: Column) -> Column:
    iri = F.concat(F.lit("<"), t["value"], F.lit(">"))
    blank = F.concat(F.lit("_:b"), F.hex(F.encode(t["value"], "UTF-8")))
    quoted = F.concat(F.lit('"'), escape(t["value"]), F.lit('"'))
    suffix = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).when(
        t["dt"] != XSD_STRING, F.concat(F.lit("^^<"), t["dt"], F.lit(">"))).otherwise("")
    return F.when(t["kind"] == IRI, iri).when(t["kind"] == BLANK, blank).otherwise(
        F.concat(quoted, suffix))


def nquads_lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """Quads as lines; blank node names are coded so that any scope gives a legal label."""
    s = F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("value"),
                 F.lit("").alias("lang"), F.lit("").alias("dt"))
    named_blank = F.col("g").startswith("_:")
    g = F.when(F.col("g").isNull(), F.lit(None)).when(
        named_blank, F.concat(F.lit("_:b"), F.hex(F.encode(F.substr("g", F.lit(3)), "UTF-8")))
    ).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit(">")))
    parts = [term_text(s), F.concat(F.lit("<"), F.col("p"), F.lit(">")), term_text(F.col("o"))]
    if graphs:
        parts.append(g)
    return quads.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str, graphs: bool = True, codec: str | None = None) -> None:
    """Compressed lines are dealt evenly before: compression takes most of the time, and the tables
    behind the quads may come in a few large pieces."""
    lines = nquads_lines(quads, graphs)
    if codec:
        lines = lines.repartition(int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    writer = lines.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    writer.text(path)
