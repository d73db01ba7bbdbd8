"""Secret scans with corpus-wide ownership of the values found, with DataFrame functions only.

Texts are cut at the matches of each kind, so lengths of pieces and matches give places. Values go on as hashes.
For each hash the distinct repositories and owners over the whole corpus are counted: a value that
several owners have, or many repositories of one, is a copied example; one that stays with an owner and doesn't look
like a placeholder is taken for live. Loose candidates (opaque runs without a keyword) become spans only by this count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import kit


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The keywords before an assigned value, in either case (A-Z only).
KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Patterns of the kinds in the order of their names in results.
PATTERNS = {
    "assign": rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "loose": r"[A-Za-z0-9+/_-]{16,}",
}
KINDS, BASE = list(PATTERNS), ("assign", "access", "hex")
#: Characters of an assigned value; distinct characters of a live one.
ASSIGNED, DISTINCT = 6, 6
#: A value of more owners or repositories than this is a copied example.
OWNERS, REPOSITORIES = 1, 3
#: Parts of values that stand for a secret in manuals.
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your_|your-|xxxx|1234|abcd"
#: Rows of one hash are joined in so many parts.
SALTS = 32


def matches(text: Column, kind: str) -> Column:
    """Array of (kind, nth, gap, size, value) of a kind's leftmost matches that don't overlap; gap: code points since the one before."""
    pattern = PATTERNS[kind]
    value = lambda m: F.regexp_extract(m, pattern, 2) if kind == "assign" else m
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    one = lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size"), value(x["m"]).alias("value")
    )
    return F.transform(F.filter(cut, lambda x: x["m"].isNotNull()), one)


def _varied(value: Column) -> Column:
    """Whether a value has many different characters and no part of a placeholder."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & ~value.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, text: str, ident: str, owner: Column, repository: Column) -> DataFrame:
    """A row for each match of each kind, one with null kind for a row without any; staged."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("ident"), owner.alias("owner"), repository.alias("repository"), F.coalesce(text, F.lit("")).alias("text"))
    listed = rows.select("row", "ident", "owner", "repository", F.concat(*(matches(F.col("text"), k) for k in KINDS)).alias("found"))
    each = listed.select("row", "ident", "owner", "repository", F.explode_outer("found").alias("f")).select("row", "ident", "owner", "repository", "f.*")
    value, kind = F.col("value"), F.col("kind")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(f"^({PATTERNS['hex']}|{PATTERNS['access']})$")
    ok = F.when(kind == KINDS.index("assign"), F.char_length("value") >= ASSIGNED).when(kind == KINDS.index("loose"), mixed).otherwise(True)
    strong = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return kit.stage(each.select("row", "ident", "owner", "repository", "kind", "nth", "gap", "size", ok.alias("ok"), F.md5(value.cast("binary")).alias("hash"), _varied(value).alias("varied"), strong.alias("strong")))


def ownership(found: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(hash, salt, shared, based): whether a value is a copied example, and whether it has a match of a base kind.

    Distinct (hash, owner, repository) come first, so a common value is counted from its owners, not its rows. A row
    for each salt that stands beside the hash, so that its many rows can be joined in parts.
    """
    base = F.col("kind") < len(BASE)
    once = found.groupBy("hash", "owner", "repository").agg(F.max(base).alias("based"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("based").alias("based"))
    verdict = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("based").alias("based"))
    verdict = verdict.select("hash", ((F.col("owners") > owners) | (F.col("repositories") > repositories)).alias("shared"), "based")
    return found.select("hash", "salt").distinct().join(verdict, "hash")


def secret_spans(docs: DataFrame, text: str = "text", ident: str = "doc_id", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(ident, spans) of every row: spans is an array of (start, kind, end, shared, live), by start and kind.

    start and end count code points, the end is exclusive; kind is a place in KINDS. Spans of base kinds always stay. A loose
    candidate is a span if it overlaps no base span of its row, its value stays with one owner and looks live, and it
    either has small and capital letters and digits or the same value stands in a base match elsewhere.

    owner and repository are columns of docs (source, and source with language, unless given); nulls are an owner like
    any other. Null and empty texts have no spans; repeated rows are rows of their own; an empty table gives an
    empty result; other columns are not looked at. A row's spans are one list: they grow with its text only.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), "lang") if repository is None else repository
    found = candidates(docs, text, ident, owner, repository)
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("gap").over(before) + F.sum("size").over(before) - F.col("size")
    placed = found.filter("kind is not null").withColumn("start", start).filter("ok")
    placed = placed.withColumns({"end": F.col("start") + F.col("size"), "salt": F.pmod(F.xxhash64("row", "nth"), F.lit(SALTS)).cast("int")})
    salted = found.filter("kind is not null and ok").withColumn("salt", F.pmod(F.xxhash64("row", "nth"), F.lit(SALTS)).cast("int"))
    judged = placed.join(ownership(salted), ["hash", "salt"])
    base = F.col("kind") < len(BASE)
    order = Window.partitionBy("row").orderBy("start", "kind")
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    live = ~F.col("shared") & F.col("varied")
    kept = judged.withColumn("clear", clear).filter(base | (F.col("clear") & live & (F.col("strong") | F.col("based"))))
    span = F.struct("start", "kind", "end", "shared", live.alias("live"))
    listed = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = found.filter("kind is null or nth = 0").groupBy("row").agg(F.first("ident").alias("ident"))
    return rows.join(listed, "row", "left").select(F.col("ident").alias(ident), F.coalesce("spans", F.expr("array()").cast(listed.schema["spans"].dataType)).alias("spans"))


def span_digests(found: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Counts by kind, base_sha256 and the joined spans of secret_spans' rows, with the numbers of added, shared and live ones."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select(
        ident, *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count(lambda x: x["kind"] >= len(BASE)).alias("n_added"), count(lambda x: x["shared"]).alias("n_shared"), count(lambda x: x["live"]).alias("n_live"),
    )
