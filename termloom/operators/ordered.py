"""Neighbours in sorted order without a window over all rows, or over a group that can be hot.

Rows are dealt into ranges of the key, each a task of its own; a small table, one row
for each range, carries what crosses a border.  Rows of one key stay in one range.
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range of a row.
PART = "_part"


def in_ranges(df: DataFrame, by: str) -> DataFrame:
    """df with its range; stored, as ranges drawn a second time could have other borders (a lost block is made anew within the same ones)."""
    return df.repartitionByRange(by).withColumn(PART, F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)


def with_neighbour(parts: DataFrame, by: str, columns: list[str], name: str, after: bool = False) -> DataFrame:
    """parts with the struct of columns of the row before (or after) in the order of `by`; null at the end."""
    move, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    row = F.struct(*columns)
    edges = parts.groupBy(PART).agg(edge(row, by).alias("_edge"))  # one row a range
    beyond = edges.select(PART, move("_edge").over(Window.orderBy(PART)).alias("_beyond"))
    inside = parts.withColumn(name, move(row).over(Window.partitionBy(PART).orderBy(by)))
    return inside.join(F.broadcast(beyond), PART).withColumn(name, F.coalesce(name, "_beyond")).drop("_beyond")


def running_count(parts: DataFrame, by: str, flag: Column) -> DataFrame:
    """parts with _run, how often the flag is set up to each row in the order of `by`."""
    marked = parts.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int"))
    sums = marked.groupBy(PART).agg(F.sum("_flag").alias("_n"))
    before = sums.select(PART, F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    inside = F.sum("_flag").over(Window.partitionBy(PART).orderBy(by))
    return marked.withColumn("_run", inside).join(F.broadcast(before), PART).withColumn("_run", F.col("_run") + F.col("_n")).drop("_n", "_flag")
