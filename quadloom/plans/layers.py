"""Two layers of published tables, and result shaping for API answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import slug
from ..sources.writers import _flat, publish, to_bindings_json


def table_name(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(slug(F.lit(name))).first()[0]


def build_layers(spark: SparkSession, layer1: dict[str, DataFrame], layer2: dict[str, str],
                 out_dir: str | None = None) -> dict[str, DataFrame]:
    """Layer 1 tables become views of plain text columns, layer 2 is SQL over them.

    A layer 2 text may use earlier layer 2 tables by name.  With ``out_dir`` all tables are
    published there.
    """
    tables: dict[str, DataFrame] = {}
    for name, df in layer1.items():
        view = table_name(spark, name)
        if view in tables:
            raise ValueError(f"two tables are named {view}")
        tables[view] = _flat(df)
        tables[view].createOrReplaceTempView(f"`{view}`" if "-" in view else view)
    for name, text in layer2.items():
        view = table_name(spark, name)
        if view in tables:
            raise ValueError(f"two tables are named {view}")
        tables[view] = spark.sql(text)
        tables[view].createOrReplaceTempView(f"`{view}`" if "-" in view else view)
    if out_dir is not None:
        publish(tables, out_dir)
    return tables


def api_result(bindings: DataFrame) -> DataFrame:
    """``{"count": n}`` as JSON and as text; 0 for an empty result."""
    n = bindings.agg(F.coalesce(F.count("*"), F.lit(0)).alias("count"))
    return n.select(F.to_json(F.struct("count")).alias("json"), F.col("count").cast("string").alias("text"))


def api_rows(bindings: DataFrame) -> DataFrame:
    """One JSON object per solution, for line-wise delivery."""
    return bindings.select(to_bindings_json(bindings).alias("json"))
