"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage and fixes row ids, whatever executor is lost later."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no plan reads any more."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tabforge/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_prefix(df: DataFrame) -> str:
    """A prefix for helper columns that no column of ``df`` starts with."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "x"
    return prefix + "_"


def one_of_each(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row for each value of ``keys``: the smallest by the other columns, in
    their order (maps are not compared), then by a hash of the text. Which row
    stays depends on the rows alone; a hot value is combined before the shuffle."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    order = [F.col(f"`{f.name}`") for f in rest if f.name != text_col and "map<" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*[F.col(f"`{f.name}`") for f in rest]), F.struct(*order, F.xxhash64(text_col)))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col("_row").getField(f.name).alias(f.name) for f in rest])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is exact, and four times
    as fast, where a text is pure ASCII."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """Add ``<c>_before``, the sum of ``c`` over all rows that sort earlier.

    One range partitioning; each partition is summed by its own window and
    moved by the totals of the partitions before it (a table of as many rows
    as partitions). No key, however frequent, puts the rows in one task as
    long as ``order`` tells rows apart. ``df`` is evaluated twice (sampling,
    then sorting): pass a cheap or materialized one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_last() for c in order]
    dealt = materialize(df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    # totals: at most ``parts`` rows
    return (dealt.join(F.broadcast(totals), "_part")
            .withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
            .drop("_part", *[f"_{c}" for c in sums]))
