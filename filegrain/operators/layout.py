"""Where rows come to lie in one order over all tasks: running sums without a window over everything, and names that don't clash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch

STEM = r"(?s)^(.*?)(?: \((\d{1,9})\))?(\.[^.]*)?\z"


def placed(df: DataFrame, order: list, length: Column) -> DataFrame:
    """df with fg_at: the sum of length (null: 0) over all rows before this one, in the given order; rows equal in it come in any order.

    Range partitions are summed each by itself and stored in the shared folder; what goes before each comes from one row a
    partition, the only thing that one task sees whole. Rows pass once through a shuffle.
    """
    spark = df.sparkSession
    rows = df.withColumn("fg_length", F.coalesce(length, F.lit(0)).cast("long"))

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = batch.column("fg_length").to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths) + total
            more = [pa.array(np.full(len(lengths), part, np.int64)), pa.array((ends - lengths).astype(np.int64))]
            yield pa.record_batch([*batch.columns, *more], [*batch.schema.names, "fg_part", "fg_inner"])
            total = int(ends[-1]) if len(ends) else total

    path = scratch(spark, "placed")
    schema = rows.schema.add("fg_part", "long").add("fg_inner", "long")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    before = F.sum("fg_sum").over(Window.orderBy("fg_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored.groupBy("fg_part").agg(F.sum("fg_length").alias("fg_sum")).select("fg_part", F.coalesce(before, F.lit(0)).alias("fg_before"))
    out = stored.join(F.broadcast(parts), "fg_part")  # one row a partition
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("fg_before") + F.col("fg_inner")).alias("fg_at"))


def apart(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows with fg_name: the first row of each name keeps it, further ones are numbered: 'a.pdf', 'a (2).pdf', 'a (3).pdf'.

    Numbers go on after the highest that names of the same stem and extension have already, by the row's place among them,
    so no two rows get the same name. Null and empty names are 'file', and so are '.' and '..'; slashes are '_'.
    """
    given = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "[/\\x00]", "_")
    safe = F.when(given.isin("", ".", ".."), F.lit("file")).otherwise(given)
    cut = rows.withColumn("fg_name", safe)
    cut = cut.withColumns({"fg_stem": F.regexp_extract("fg_name", STEM, 1), "fg_number": F.regexp_extract("fg_name", STEM, 2), "fg_ext": F.regexp_extract("fg_name", STEM, 3)})
    at = placed(cut, ["fg_stem", "fg_ext", "fg_name", *order], F.lit(1))
    stems = at.groupBy("fg_stem", "fg_ext").agg(F.min("fg_at").alias("fg_from"), F.greatest(F.max(F.expr("try_cast(fg_number AS INT)")), F.lit(1)).alias("fg_most"))
    names = at.groupBy("fg_name").agg(F.min("fg_at").alias("fg_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = at.join(names, "fg_name", "left").join(stems, ["fg_stem", "fg_ext"])
    number = (F.col("fg_most") + F.col("fg_at") - F.col("fg_from")).cast("string")
    told = F.when(F.col("fg_at") > F.col("fg_first"), F.concat("fg_stem", F.lit(" ("), number, F.lit(")"), "fg_ext")).otherwise(F.col("fg_name"))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], told.alias("fg_name"))
