"""Queries op1 to op13 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, idfile, jaccard, kit, media, mixing, repetition, resample, secrets, shard, spelling, target, toxicity, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(kit.table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(kit.table(spark, sf_dir, "documents").select("doc_id", "text"), words=5, percent=75)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Tokens and digests of every row of docs, encoded and decoded."""
    path = vocabulary("byte_bpe_50k.json")
    coded = bpe.bpe_round_trip(docs.select("doc_id", "text"), path).drop("text")
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(kit.table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.words_of(F.col("text")).alias("size"))
    return mixing.mix_plan(sized, weights=(5, 2, 1), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = kit.shared_dir(spark)
    idfile.write_id_files(kit.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder, end=2)
    read = idfile.read_id_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = media.pack_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return media.read_media(packed).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = repetition.repetition_rules(kit.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_mark_chars", *(f"dup_chars_{n}" for n in repetition.LIMITS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.train(docs, kit.table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, field)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = kit.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("target"))
    return resample.resample(kit.table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(kit.table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "payload_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.secret_spans(kit.table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(kit.table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.draw_towards(kit.table(spark, sf_dir, "documents").select("doc_id", "text"), kit.table(spark, sf_dir, "benchmark").select("text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_sharding, op2_jaccard_join, op3_bpe, op4_mixing, op5_id_files, op6_media, op7_quality_rules, op8_toxicity, op9_resampling, op10_warc, op11_secrets, op12_spelling, op13_target_resampling, pipeline)
    return {f.__name__: f for f in own}


OP4_SQL = r"""
WITH RECURSIVE
docs AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1') AS k FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0 * source_size AS lim FROM sizes),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed),
water AS (SELECT min(lev) AS water FROM (SELECT lev FROM levels WHERE lev * w <= lim ORDER BY lim / w LIMIT 1)),
targets AS (SELECT source, source_size, coalesce(least(lim, water * w), lim) AS target FROM levels, water),
ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - CAST(floor(target / source_size) AS BIGINT) * source_size - before)) END AS BIGINT) AS taken
FROM ranked
"""


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _covered_sql(name: str, table: str, n: int, value: str) -> str:
    """Of each row r of documents: the sum of value over tokens x that lie in a window of n that stands twice or more."""
    window = ", ".join(["x", *(f"lead(x, {k}) OVER w" for k in range(1, n))])
    grams = f"SELECT r, i, x, CASE WHEN lead(x, {n - 1}) OVER w IS NOT NULL THEN concat_ws(' ', {window}) END AS g FROM {table} WINDOW w AS (PARTITION BY r ORDER BY i)"
    hits = f"SELECT r, i, x, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS h FROM ({grams}) a"
    inside = f"SELECT r, x, bool_or(h) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM ({hits}) b"
    return f"{name} AS (SELECT r, sum(CASE WHEN c THEN {value} ELSE 0 END) AS v FROM ({inside}) d GROUP BY r)"


def op7_sql() -> str:
    limits, names = repetition.LIMITS, [f"dup_chars_{n}" for n in repetition.LIMITS]
    steps = [
        "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)",
        f"word AS (SELECT r, i, x FROM (SELECT r, unnest({_WORDS}) AS x, generate_subscripts({_WORDS}, 1) AS i FROM docs) u)",
        "line AS (SELECT r, row_number() OVER (PARTITION BY r, x ORDER BY i) > 1 AS later, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) u "
        "WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]'))",
        "mark AS (SELECT r, i, x FROM (SELECT r, unnest(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) AS x, generate_subscripts(regexp_extract_all(text, '[!-/:-@\\[-`{-~]'), 1) AS i FROM docs) u)",
        "words AS (SELECT r, count(*) AS n_words, sum(length(x)) AS word_chars FROM word GROUP BY r)",
        "lines AS (SELECT r, count(*) FILTER (WHERE later) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE later), 0) AS dup_line_chars FROM line GROUP BY r)",
        _covered_sql("again", "word", repetition.WINDOW, "1"), _covered_sql("marks", "mark", repetition.MARKS, "1"), *(_covered_sql(c, "word", n, "length(x)") for c, n in zip(names, limits, strict=True)),
    ]
    long = lambda c, name: f"CAST(coalesce({c}, 0) AS BIGINT) AS {name}"
    columns = [
        long("n_words", "n_words"), long("word_chars", "word_chars"), "CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols", long("n_dup_lines", "n_dup_lines"), long("again.v", "n_repeat_words"),
        long("dup_line_chars", "dup_line_chars"), long("marks.v", "dup_mark_chars"), *(long(f"{c}.v", c) for c in names),
    ]
    joins = " ".join(f"LEFT JOIN {t} USING (r)" for t in ("words", "lines", "again", "marks", *names))
    failed = f"n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_PERCENT} * n_words"
    parts = {"dup_line_chars": repetition.LINE_LIMIT, "dup_mark_chars": repetition.MARK_LIMIT, **dict(zip(names, limits.values(), strict=True))}
    good = " AND ".join(f"{c} <= CAST({x} AS DOUBLE) * greatest(word_chars, 1)" for c, x in parts.items())
    return f"WITH {', '.join(steps)} SELECT *, {failed} AS base_failed, NOT ({failed}) AND {good} AS kept FROM (SELECT doc_id, {', '.join(columns)} FROM docs {joins}) x"


OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM sh l JOIN sh r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2) p
  JOIN sizes sa ON sa.doc_id = p.a JOIN sizes sb ON sb.doc_id = p.b WHERE 100 * common >= 75 * (sa.n + sb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT doc_id, list(x ORDER BY x) AS k FROM sh GROUP BY doc_id) s)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(classes.class_id, w.doc_id) AS class_id, components.component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id) JOIN components ON components.a = w.doc_id
"""


#: ``tab``: the 256 values of CRC-32's table in one list; _crc gives the CRC of a text beside it.
_TAB = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    byte = f"CAST('0x' || substr(hex({text}), 2 * k + 1, 2) AS BIGINT)"
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda k: {byte})), lambda c, b: {step}), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_sql() -> str:
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in secrets.PATTERNS.items()}
    docs = "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS owner, concat(coalesce(source, ''), chr(0), coalesce(lang, '')) AS repo, coalesce(text, '') AS text FROM documents)"
    part = "SELECT r, {k} AS kind, unnest(m) AS m, unnest(list_transform(range(len(m)), lambda i: list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))) AS s FROM (SELECT r, regexp_extract_all(text, {q}) AS m, string_split_regex(text, {q}) AS p FROM docs) d"
    found = "found AS (" + " UNION ALL ".join(part.format(k=k, q=q) for k, q in enumerate(quoted.values())) + ")"
    value = f"CASE kind WHEN 0 THEN regexp_extract(m, {quoted['assign']}, 2) ELSE m END"
    mixed = f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_full_match(v, '{secrets.PATTERNS['hex']}|{secrets.PATTERNS['access']}')"
    good = f"good AS (SELECT r, owner, repo, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM (SELECT *, {value} AS v FROM found) x JOIN docs USING (r) WHERE CASE kind WHEN 0 THEN length(v) >= {secrets.ASSIGNED} WHEN 3 THEN {mixed} ELSE true END)"
    owned = f"owned AS (SELECT v, count(DISTINCT owner) > {secrets.OWNERS} OR count(DISTINCT (owner, repo)) > {secrets.REPOSITORIES} AS shared, bool_or(kind < 3) AS based FROM good GROUP BY v)"
    live = f"NOT shared AND len(list_distinct(string_split(v, ''))) >= {secrets.DISTINCT} AND NOT regexp_matches(v, '{secrets.PLACEHOLDER}')"
    clear = "NOT EXISTS (SELECT 1 FROM good b WHERE b.r = g.r AND b.kind < 3 AND b.s < g.e AND g.s < b.e)"
    strong = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') OR based"
    spans = f"spans AS (SELECT r, kind, s, ['assign', 'access', 'hex', 'loose'][kind + 1] || ':' || s || ':' || e AS x, shared, {live} AS live FROM good g JOIN owned USING (v) WHERE kind < 3 OR {live} AND ({strong}) AND {clear})"
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = {k}) AS n_{n}" for k, n in enumerate(secrets.BASE))
    text = lambda test: f"coalesce(string_agg(x, ',' ORDER BY s, kind){test}, '')"
    return (
        f"WITH {docs}, {found}, {good}, {owned}, {spans} SELECT doc_id, {counts}, sha256({text(' FILTER (WHERE kind < 3)')}) AS base_sha256, {text('')} AS spans, "
        "count(kind) FILTER (WHERE kind = 3) AS n_added, count(kind) FILTER (WHERE shared) AS n_shared, count(kind) FILTER (WHERE live) AS n_live FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id"
    )


OP12_SQL = f"""
WITH RECURSIVE {_TAB},
runs AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS x FROM documents) u GROUP BY doc_id, x),
checked AS (SELECT x, k, {_crc("y")} AS h FROM (SELECT x, k, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', x) AS y FROM runs) r, tab),
changed AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(x, 1, CAST(h % length(x) AS BIGINT)) || substr(x, CAST(h % length(x) AS BIGINT) + 2) ELSE x END AS word FROM checked),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
shorter AS (SELECT word, n, 0 AS i, word AS x FROM words UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) w),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.x = b.x AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS here, 0 AS k FROM words UNION ALL SELECT s.word, f.form, s.k + 1 FROM steps s JOIN formed f ON f.word = s.here WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY word) r USING (word)
"""


OP13_SQL = rf"""
WITH {_TAB},
texts AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
feature AS (SELECT kind, r, x, count(*) AS k FROM (SELECT kind, r, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM texts) u GROUP BY kind, r, x),
hashed AS (SELECT x, CAST({_crc("x")} % 10000 AS INT) AS bucket FROM (SELECT DISTINCT x FROM feature) d, tab),
bucketed AS (SELECT kind, r, bucket, sum(k) AS k FROM feature JOIN hashed USING (x) GROUP BY kind, r, bucket),
counted AS (SELECT bucket, CAST(coalesce(sum(k) FILTER (WHERE kind = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(k) FILTER (WHERE kind = 1), 0) AS DOUBLE) AS t FROM bucketed GROUP BY bucket),
gained AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counted),
weighed AS (SELECT r, CAST(sum(k) AS BIGINT) AS n, CAST(sum(k * gain) AS BIGINT) AS w FROM bucketed JOIN gained USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT b.r, b.doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM texts b LEFT JOIN weighed USING (r) WHERE kind = 0),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": OP2_SQL.strip(), "op4_mixing": OP4_SQL.strip(), "op7_quality_rules": op7_sql(), "op11_secrets": op11_sql(), "op12_spelling": OP12_SQL.strip(), "op13_target_resampling": OP13_SQL.strip(),
    }
