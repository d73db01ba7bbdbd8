"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a uniform key of hexadecimal digits (hash of the text, hash of the id, number of
the row, so equal texts lie side by side and a large group of them can still be cut). Splitters are
found by counting, exactly and in all partitions at once, the bytes and rows in cells between
candidate boundaries; each pass looks only into the cells that hold an unsettled splitter, until its
cell is within tolerance or holds one key. Then one exchange puts the rows where they belong.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit

#: Digits of the first and of each further pass.
FIRST, STEP = 3, 2


def sort_key(text: Column, ident: Column) -> Column:
    digits = lambda c: F.lpad(F.hex(F.xxhash64(c)), 16, "0")
    return F.concat(digits(text), digits(ident))


class _Target:
    """A wanted number of bytes or rows below a splitter, and the cell that holds it."""

    def __init__(self, measure: int, want: float, tolerance: float):
        self.measure, self.want, self.tolerance = measure, want, tolerance
        self.prefix, self.below = "", (0, 0)
        self.found: tuple[str, tuple[int, int]] | None = None

    def narrow(self, cells: list[tuple[str, int, int, str, str]]) -> None:
        """cells: digits, bytes, rows, smallest and largest key, in order, all below my prefix."""
        below = self.below
        for digits, size, rows, least, most in cells:
            upto = (below[0] + size, below[1] + rows)
            if upto[self.measure] >= self.want or digits == cells[-1][0]:
                inside = (size, rows)[self.measure]
                if inside <= self.tolerance or least == most:
                    near = self.want - below[self.measure] <= upto[self.measure] - self.want
                    self.found = (digits, below) if near else (digits + "g", upto)  # "g" follows every digit
                else:
                    same = next(i for i in range(len(least)) if least[i] != most[i])
                    self.prefix, self.below = least[:same], below
                return
            below = upto


def splitters(df: DataFrame, key: str, size: str, shards: int, parts: int, tolerance: float) -> tuple[list[tuple[str, int, int]], int]:
    """Boundaries (key, rows below it, shards that start at or before it) in order, and the passes made."""
    total, count = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    by_bytes = [_Target(0, total * i / shards, tolerance * total / shards) for i in range(1, shards)]
    by_rows = [_Target(1, count * i / parts, 0.1 * count / parts) for i in range(1, parts)]
    open_, passes = [*by_bytes, *by_rows] if count else [], 0
    while open_:
        passes += 1
        lengths: dict[int, set[str]] = {}
        for t in open_:
            lengths.setdefault(len(t.prefix), set()).add(t.prefix)
        cell = F.coalesce(*(
            F.when(F.substring(key, 1, n).isin(*sorted(p)) if n else F.lit(True), F.substring(key, 1, n + (STEP if n else FIRST))) for n, p in lengths.items()
        ))
        counted = df.select(cell.alias("cell"), key, size).filter("cell is not null").groupBy("cell").agg(F.sum(size), F.count("*"), F.min(key), F.max(key))
        cells: dict[str, list] = {}
        for row in sorted(map(tuple, counted.collect())):
            parent = next(p for n, known in lengths.items() if (p := row[0][:n]) in known)
            cells.setdefault(parent, []).append(row)
        for t in open_:
            t.narrow(cells[t.prefix])
        open_ = [t for t in open_ if t.found is None]
    starts = sorted(t.found[0] for t in by_bytes) if count else []
    rows = {t.found[0]: t.found[1][1] for t in (*by_bytes, *by_rows) if t.found}
    return [(b, rows[b], bisect_right(starts, b)) for b in sorted(rows)], passes


def histogram_shards(df: DataFrame, key: str, size: str, shards: int = 16, tolerance: float = 1e-3, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with the shard of each row and its gapless place there, in key order.

    The shards' sums of ``size`` differ by at most ``tolerance`` of a shard and one row or one
    group of equal keys at each end: rows with the same key stay together. ``key`` has digits 0-F
    (see sort_key) and is never null; ``size`` is positive. An empty table stays empty. Columns named
    like the two new ones are replaced; all others are kept. Repeated rows keep their number.

    df is read once for each pass, so stage it before if it is costly; it must be the same
    at each reading.
    """
    df = kit.without(df, shard, slot)
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, _ = splitters(df, key, size, shards, parts, tolerance)
    # cell of FIRST digits -> boundaries inside it and how many lie before it: at most 16**FIRST rows
    inside: dict[str, list[str]] = {}
    for b, _, _ in bounds:
        inside.setdefault(b[:FIRST], []).append(b)
    keys = [b for b, _, _ in bounds]
    lookup = [(p, bisect_left(keys, p), sorted(inside.get(p, []))) for p in (f"{i:0{FIRST}X}" for i in range(16**FIRST))]
    small = F.broadcast(df.sparkSession.createDataFrame(lookup, "_cell string, _before int, _inside array<string>"))
    bucket = F.col("_before") + F.size(F.filter("_inside", lambda b: b <= F.col(key)))
    of = [0, *(s for _, _, s in bounds)]
    begin = {0: 0}
    for _, below, s in bounds:
        begin.setdefault(s, below)
    first = [0 - begin[0], *(below - begin[s] for _, below, s in bounds)]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_bucket") + 1)
    placed = df.withColumn("_cell", F.substring(key, 1, FIRST)).join(small, "_cell").withColumn("_bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return placed.withColumns({shard: at(of).cast("int"), slot: at(first).cast("long") + rank - 1}).drop("_cell", "_before", "_inside", "_bucket")


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, size, text_crc32, law, shard, slot, grown_shard of every row; sizes are near equal.

    size is the UTF-8 bytes of the text plus 1; a null text has none (size 1, checksum 0). A null id
    is an id like any other. Equal texts follow each other and are cut only where a shard is full. Rows equal in text
    and id stand for each other, so a number of the staged row ends their key and many of them can be cut.
    The driver holds the splitters, and of a pass at most 256 cells for each that is still open.
    """
    narrow = docs.select(
        F.col(ident), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.concat(sort_key(F.col(text), F.col(ident)), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("key"),
    )
    out = histogram_shards(kit.stage(narrow), "key", "size", shards)
    return out.select(ident, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
