"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys; each source is range-sorted by them in cells, prefix sums of sizes run
over the cells of a source and then over the rows of a cell, and each source is cut at its exact
budget. A budget above the source's size takes whole epochs first. The cell of a row depends on its
key alone, so a source with most of the rows is spread over as many tasks as the others together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a cell that are aimed at, and the most cells of a source.
CELL_ROWS, CELLS = 256, 65_536


def random_key(ident: Column, seed: int) -> Column:
    """32 hexadecimal digits, the same in every run."""
    return F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n_rows, target) from one row per source.

    Weights repeat over the sources by code point, null last. The pool is ``share`` of all sizes;
    a source stops at ``most`` times its size and the excess goes to the rest by weight: with
    sources in the order of limit / weight, those are full whose limit is below what the
    level of the rest would give them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(whole)["level"]
    # once a source in this order is free all later ones are; the first free one has the level
    return levels.withColumn("water", water).select(
        "source", "source_size", "n_rows", F.coalesce(F.least("limit", F.col("water") * F.col("weight")), F.col("limit")).alias("target")
    )


def keyed_rows(df: DataFrame, seed: int, ident: str, source: str, size: str, row: str | None) -> DataFrame:
    """(id, source, size, row, key) of every row: the key is random, one for an id unless the id has many rows."""
    rows = df.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), *([F.col(row).alias("row")] if row else []))
    rows = rows if row else kit.keyed(rows).withColumnRenamed(kit.ROW, "row")
    # an id of many rows, a null one among them, would have one key: those rows take their number into it
    often = kit.stage(rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS).select(F.col("id").alias("often"), F.lit(True).alias("again")))
    marked = rows.join(kit.sized(often), F.col("id").eqNullSafe(F.col("often")), "left")
    numbered = F.concat_ws(":", F.col("id").cast("string"), F.col("row").cast("string"))
    return marked.select("id", "source", "size", "row", random_key(F.when(F.col("again"), numbered).otherwise(F.col("id").cast("string")), seed).alias("key"))


def mix_plan(
    df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1,
    ident: str = "doc_id", source: str = "source", size: str = "size", row: str | None = None,
) -> DataFrame:
    """(ident, source, size, source_size, target, epochs, cut, taken[, row]) of every row; row names a unique long key of a staged df.

    The mix holds ``epochs`` whole copies of the row and then ``cut`` of its words; taken is the sum.
    Of a source, the taken sizes add up to its target, rounded down. Rows of size 0 take nothing.
    A null source is a source. Rows are ordered by key, then id, size and row; of an id with over CELL_ROWS rows (null is
    an id) they have keys of their own. Without row, df's rows are numbered as they are staged. An empty table gives an empty result.
    """
    rows = keyed_rows(df, seed, ident, source, size, row)
    own = ["row"]
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share, most)
    sizes = kit.stage(sizes.withColumn("cells", F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / CELL_ROWS))).cast("int")))
    # equal parts of the key's first 32 bits: the order of the cells is the order of the keys
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    joined = rows.alias("r").join(kit.sized(sizes).alias("s"), same)
    celled = joined.select("r.id", "r.source", "size", "key", *own, "source_size", "target", F.shiftright(part * F.col("cells"), 32).cast("int").alias("cell"))
    sums = celled.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("source_"), F.col("cell").alias("cell_"), F.coalesce(F.sum("in_cell").over(up_to), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "cell").orderBy("key", "id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("cell") == F.col("cell_")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("within")
    out = placed.withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("cut", F.least("size", F.greatest(F.lit(0), rest)).cast("long"))
    return out.select(
        F.col("id").alias(ident), F.col("source").alias(source), F.col("size").alias(size), "source_size", "target", "epochs", "cut",
        (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), *([F.col("row").alias(row)] if row else []),
    )


def words_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix holds them: each row once for every epoch, and cut ones with their first words.

    Null and repeated ids are rows like others; rows that the mix takes nothing of are gone.
    """
    keyed = kit.keyed(docs)
    sized = kit.stage(keyed.select(kit.ROW, "doc_id", "source", words_of(F.col("text")).alias("size")))
    plan = mix_plan(sized, row=kit.ROW, **options).filter("taken > 0").select(kit.ROW, "size", "epochs", "cut")
    copies = F.concat(F.expr("array_repeat(size, cast(epochs as int))"), F.when(F.col("cut") > 0, F.array("cut")).otherwise(F.expr("array()").cast("array<bigint>")))
    plan = plan.select(kit.ROW, F.col("size").alias("_size"), F.explode(copies).alias("_words"))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    rows = keyed.join(plan, kit.ROW).withColumn("text", F.when(F.col("_words") < F.col("_size"), short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_words") < F.col("_size"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
