"""Running sums over groups of any size.

A window over a group is one task's. Here rows are dealt by ranges of group and order, so a large group is in several parts; each part is summed up,
the parts before give each its offset, and only within a part do sums run. The parts of a group are as many as ranges at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import shared_dir

#: Subsets of a group in which a budget is spent on its own before the whole is looked at.
SUBSETS = 64


def totals(rows: DataFrame, group: str, order: list[str], size: str, into: str = "total", most: int | None = None) -> DataFrame:
    """`rows` with the sum of `size` (not negative; null: none) of a group's rows up to each, itself included, in the order of some columns, ties by all columns.

    Without `most`, every row stays; with it, only those whose sum is no more, and parts that begin beyond it are dropped before they are
    sorted. The parts are cut once, by a reliable checkpoint, as their offsets and their sums must mean the same ones.
    """
    shared_dir(rows.sparkSession)
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct", "variant", "binary"))]
    keyed = rows.withColumn("_tie", F.xxhash64(*plain))
    parts = keyed.repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_s"))
    offsets = offsets.select("_g", "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    if most is not None:
        offsets = offsets.where(F.col("_before") <= most)
    placed = parts.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    within = Window.partitionBy("_part", group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn(into, F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    out = out.where(F.col(into) <= most) if most is not None else out
    return out.select(*[c for c in rows.columns if c != into], into)


def spent(rows: DataFrame, group: str, order: list[Column], size: Column, budget: int, into: str = "used") -> DataFrame:
    """The rows of each group before which less than `budget` was used, with what was used, in some order. size is one at least.

    A row that stays in the whole group also stays in any subset of it, as less is used before it there. So SUBSETS of each group, by hash, spend the
    budget on their own first; of each no more than `budget` rows are left, so the window over the whole group sees a bounded number however
    large it is.
    """
    before = lambda *by: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    few = rows.withColumn("_subset", F.pmod(F.xxhash64(*plain), F.lit(SUBSETS)).cast("int")).withColumn(into, before(group, "_subset")).where(F.col(into) < budget)
    return few.drop("_subset", into).withColumn(into, before(group)).where(F.col(into) < budget)
