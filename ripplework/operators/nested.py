"""Values nested to any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.session import materialize


def string_leaves(df: DataFrame, json: Column, *keep: str, strict: bool = True) -> DataFrame:
    """(keep, path, leaf): every string value of a JSON text, in objects and arrays of any depth; keys do not count.

    A worklist over variants: each round takes objects and arrays one level apart, hands out the strings and writes what is
    nested deeper, so rounds are as many as levels and a round is one pass without a shuffle. Null and empty texts have no
    leaves; a text that is not JSON raises, or has none if not `strict`.
    """
    text = F.when(F.trim(json) != "", json)
    work = df.select(*keep, F.lit("$").alias("path"), (F.parse_json(text) if strict else F.try_parse_json(text)).alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    out = []
    while True:
        level = materialize(work.withColumn("__kind", F.when(kind == "STRING", "leaf").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "nest")).where("__kind is not null"), "level")
        out.append(level.where("__kind = 'leaf'").select(*keep, "path", F.variant_get("v", "$", "string").alias("leaf")))
        nest = level.where("__kind = 'nest'").withColumnsRenamed({"v": "__v", "path": "__p"}).drop("__kind")
        if nest.isEmpty():
            return reduce(DataFrame.union, out)
        apart = nest.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        work = apart.select(*keep, F.concat("__p", step).alias("path"), F.col("value").alias("v"))
