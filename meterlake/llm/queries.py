"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import decontaminate, importance, jaccard_groups, licenses, line_dedup, media, packing, pages, prefix_trie, quality, repacking, secrets, urls
from meterlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + (r["last"] - r["first"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op1_decontaminate"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, i, w[i : i + n - 1] AS win FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, item_id, n, i FROM spots JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL["op3_line_dedup"] = line_dedup.dedup_sql()


@query
def op4_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups.link(table(spark, folder, "documents"), words=4, percent=85).drop("th")


SHINGLE_WORDS = "regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
SQL["op4_jaccard_groups"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {SHINGLE_WORDS} AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * o >= 85 * (x.n + y.n - o)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_id l ON d.doc_id = l.a"""


@query
def op5_media(spark: SparkSession, folder: str) -> DataFrame:
    stored = media.store_texts(table(spark, folder, "documents")).withColumn("declared", F.lit("application/octet-stream"))
    lengths = stored.select("doc_id", "n_bytes", "body", "declared")
    found = media.sniff(lengths.withColumn("key", F.struct("doc_id", "n_bytes")), "key", "declared", "body")
    found = media.read_back(found, "key", "body").withColumn("n_embedded", F.size("embedded").cast("long"))
    return found.select("key.*", "*").drop("key", "embedded")


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, folder, "labels")))
    predicted = (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", predicted)


@query
def op7_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


@query
def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES)


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("guess").alias("n_guess"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


@query
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return _licences(licenses.scan(table(spark, folder, "documents")))


@query
def op10_license_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _licences(licenses.scan_texts(table(spark, folder, "documents")))


def _licences(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("licences", ",").alias("licences"),
        F.array_join("unmatched", ",").alias("unmatched"),
    )


SQL["op10_licenses"] = licenses.scan_sql()
SQL["op10_license_texts"] = licenses.scan_texts_sql()


@query
def op11_repacking(spark: SparkSession, folder: str) -> DataFrame:
    pieces = repacking.pack_best_fit(table(spark, folder, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The checksum of a text: a table from its polynomial, then one step for each byte.
CRC_TABLE = """bits(b, k, c) AS (SELECT b, 0, CAST(b AS BIGINT) FROM range(256) t(b) UNION ALL
    SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""
CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(1, 2 * octet_length(encode({0})), 2), lambda i: CAST('0x' || substr(hex(encode({0})), i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""
SQL["op12_importance"] = f"""
WITH RECURSIVE {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
g AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM benchmark) GROUP BY w),
hashed AS MATERIALIZED (SELECT w, {CRC.format("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
source AS (SELECT bucket, sum(n) AS s FROM f JOIN hashed USING (w) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM g JOIN hashed USING (w) GROUP BY bucket),
gains AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(
    (coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM source), 0) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM target), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket)),
weights AS (SELECT doc_id, sum(n) AS n_features, CAST(floor(sum(gain * n) / sum(n)) AS BIGINT) AS weight
    FROM f JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS MATERIALIZED (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, place AS rank FROM scored s
LEFT JOIN drawn r ON s.doc_id = r.doc_id AND place <= 10 * n // 100"""


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


SQL["op13_prefix_trie"] = f"""
WITH RECURSIVE {CRC_TABLE},
t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, {CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t), crc),
said AS (SELECT c.conv_id, k, role, text FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE k <= h
    UNION ALL SELECT conv_id, k, role, text FROM convs JOIN t USING (conv_id) WHERE k > h),
rebuilt AS MATERIALIZED (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY k) AS turns,
    list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY k) AS words FROM said GROUP BY conv_id
    UNION ALL SELECT conv_id, [], [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM said)),
members AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(turns[1 : d], '')) AS key, d = len(turns) AS ends,
    CASE WHEN d > 0 THEN words[d] ELSE 0 END AS n_words
    FROM (SELECT conv_id, turns, words, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY d, key),
edges AS MATERIALIZED (SELECT n.d, n.key, up.conv_id AS parent_conv_id, up.key AS up FROM nodes n
    JOIN members m ON m.conv_id = n.conv_id AND m.d = n.d - 1 JOIN nodes up ON up.d = m.d AND up.key = m.key),
families AS MATERIALIZED (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM edges GROUP BY ALL),
below AS (SELECT m.d, m.key, sum((n.n_convs - 1) * n.n_words) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
    FROM nodes n LEFT JOIN families f ON f.d = n.d AND f.key = n.key
    JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.d, m.key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.key = n.key LEFT JOIN edges e ON e.d = n.d AND e.key = n.key
LEFT JOIN families f ON f.d = n.d AND f.key = n.key"""
