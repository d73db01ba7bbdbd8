"""Running values along rows in order, without a window over a whole key.

Rows are range-sorted by key and order into parts. Inside a part a window gives what lies before a row there; what
lies in other parts comes from a summary of each part and key. As parts follow each other in key order, only the first
and the last key of a part can go on in another, so there are at most two summaries a part to hand on. A key
with most of the rows is spread over as many tasks as all others together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.plans.shared import staged

PART = "_part"
#: Rows in memory that one task is to hold, a row's own bytes, and what a task may hold where STRAIGHT partitions are too few.
PART_BYTES, ROW_BYTES, MOST_BYTES = 32 << 20, 150, 512 << 20
#: Up to so many partitions Spark writes each one straight to its file; with more a task holds what it writes.
STRAIGHT = 200
_FOLDS = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}


def width(df: DataFrame, *wide: str) -> int:
    """Partitions for df by its rows and the bytes of its wide columns in memory; as many as there are cores at least, if these aren't more than STRAIGHT.

    What a shuffle without a number is cut by are its compressed bytes, which say nothing of a task's memory: payloads that repeat themselves
    become a thirtieth.
    """
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in wide), F.lit(ROW_BYTES)))).first()[0] or 0
    return max(min(max(-(-size // PART_BYTES), df.sparkSession.sparkContext.defaultParallelism), STRAIGHT), -(-size // MOST_BYTES))


def dealt(df: DataFrame, keys: list[str], order: list[str], into: int | None = None) -> DataFrame:
    """df range-sorted by keys and order, staged with the number of each row's part; into: how many parts (else by compressed bytes)."""
    sorted_ = df.repartitionByRange(into, *keys, *order) if into else df.repartitionByRange(*keys, *order)
    return staged(sorted_.withColumn(PART, F.spark_partition_id()))


def running(parts: DataFrame, keys: list[str], order: list[str], into: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """parts (from dealt, by the same keys and order) with a column for each value: its fold over the rows of the key before this one.

    values: name=(fold, column); fold is sum (0 where there is nothing), max, last or first (of values that aren't null; else null). A
    fold with a minus before its name goes over the rows after this one, the nearest first. Rows that
    agree in keys and order must not be told apart by what comes out; null keys are keys. into: partitions of
    the work (see width).
    """
    own = [*keys, PART]
    named = (parts.repartition(into, *own) if into else parts).withColumns({f"_of_{n}": c for n, (_, c) in values.items()})
    back = lambda fold: fold.startswith("-")
    fold_of = lambda fold: _FOLDS[fold.lstrip("-")]
    ahead = lambda by, at, fold: Window.partitionBy(*by).orderBy(*(F.col(c).desc() if back(fold) else F.col(c).asc() for c in at)).rowsBetween(Window.unboundedPreceding, -1)
    local = named.withColumns({f"_in_{n}": fold_of(f)(f"_of_{n}").over(ahead(own, order, f)) for n, (f, _) in values.items()})
    place = F.struct(*order)

    def summary(n: str, fold: str) -> Column:
        """The fold over a part's rows, from the side that is nearest to the row that asks."""
        c, kind = F.col(f"_of_{n}"), fold.lstrip("-")
        if kind in ("sum", "max"):
            return _FOLDS[kind](c)
        return (F.max_by if (kind == "last") != back(fold) else F.min_by)(c, F.when(c.isNotNull(), place))

    sums = named.groupBy(*own).agg(*(summary(n, f).alias(f"_sum_{n}") for n, (f, _) in values.items()))
    carried = (sums.repartition(into, *keys) if into else sums).select(*own, F.count("*").over(Window.partitionBy(*keys)).alias("_parts"), *(fold_of(f)(f"_sum_{n}").over(ahead(keys, [PART], f)).alias(f"_all_{n}") for n, (f, _) in values.items()))
    few = staged(carried.filter("_parts > 1").drop("_parts"))  # two rows for each border of parts at most
    same = [*(F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys), F.col(f"x.{PART}") == F.col(f"y.{PART}")]
    joined = local.alias("x").join(F.broadcast(few.alias("y")), same, "left")

    def both(n: str, fold: str) -> Column:
        near, far, kind = F.col(f"_in_{n}"), F.col(f"_all_{n}"), fold.lstrip("-")
        if kind == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        if kind == "max":
            return F.greatest(near, far)
        return F.coalesce(near, far) if kind == "last" else F.coalesce(far, near)

    return joined.select(*(F.col(f"x.{c}") for c in parts.columns), *(both(n, f).alias(n) for n, (f, _) in values.items()))
