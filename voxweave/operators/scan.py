"""Running labels and runs of equal labels over sources of any length, in two levels.

A source's rows are dealt by stretches of its order. Each stretch is scanned by itself; of it only a summary travels: its first and
last label and how often the label changes. The summaries of a source, one row per stretch, are scanned in order, and give each
stretch the label and the run that it begins with. So no task holds a source, however long one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxweave.shared import saved

#: Numbers of seq that a stretch spans.
STRETCH = 50_000


def numbered(rows: DataFrame, label: Column, first: Column, stretch: int = STRETCH) -> DataFrame:
    """rows (source_id, seq, ...) with _label, the label or the last one before it that is not null, and _run, the number of the run of equal labels.

    first: what rows have before the first label of their source. seq has each number once in a source; rows without seq come first.
    The result is written to the shared folder.
    """
    place = ["source_id", "_stretch"]
    dealt = rows.withColumn("_stretch", F.floor(F.coalesce(F.col("seq"), F.lit(0)) / F.lit(stretch)).cast("long")).withColumn("_own", label)
    order = Window.partitionBy(*place).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    known = dealt.withColumn("_local", F.last("_own", ignorenulls=True).over(so_far))
    before = F.lag("_local").over(order)
    known = known.withColumn("_change", (before.isNotNull() & (before != F.col("_local"))).cast("long"))
    known = saved(known.withColumn("_changes", F.sum("_change").over(so_far)).drop("_change", "_own"))

    got = F.col("_local").isNotNull()
    each = known.groupBy(*place).agg(
        F.min(F.when(got, F.struct("seq", "_local"))).alias("first"),
        F.max(F.when(got, F.struct("seq", "_local"))).alias("last"),
        F.max("_changes").alias("changes"),
        F.max((~got).cast("int")).alias("leads"),
    )
    ahead = Window.partitionBy("source_id").orderBy("_stretch")
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("carry", F.last("last._local", ignorenulls=True).over(earlier)).withColumn("opens", F.row_number().over(ahead) == 1)
    # rows before the first label of a source are a run of their own
    each = each.withColumn("leads", F.max(F.when(F.col("opens"), F.col("leads"))).over(ahead.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    given = F.coalesce(F.col("carry"), F.when(F.col("leads"), first))
    each = each.withColumn("given", given).withColumn("turns", F.col("first").isNotNull() & (F.col("given").isNull() | (F.col("given") != F.col("first._local"))))
    through = F.col("turns").cast("long") + F.col("changes")
    # the run that is open before the stretch: -1 before a source that begins with a label
    each = each.withColumn("open", F.when(F.max("leads").over(Window.partitionBy("source_id")), 0).otherwise(-1) + F.coalesce(F.sum(through).over(earlier), F.lit(0)))
    found = known.join(each.select(*place, "given", "turns", "open"), place)
    run = F.col("open") + F.when(F.col("_local").isNotNull(), F.col("turns").cast("long") + F.col("_changes")).otherwise(F.lit(0))
    return found.withColumn("_label", F.coalesce("_local", "given", first)).withColumn("_run", run).drop("_stretch", "_local", "_changes", "given", "turns", "open")
