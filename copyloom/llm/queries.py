"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copyloom.llm import chat, decontaminate, forest, html_text, jaccard, mixing, neighbours, quality, secrets, substrings, tries, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_formatted(chat.format_conversations(rows))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, fitted on labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, and weak candidates next to complementary parts, in all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark, and how much of them."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur elsewhere."""
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the leading eight components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, by a forest of sorted signatures, and which one stays."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations share or end with, and what lies below it."""
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_html": op2_html,
    "op3_quality": op3_quality,
    "op4_jaccard": op4_jaccard,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_substrings": op7_substrings,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_forest": op12_forest,
    "op13_tries": op13_tries,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
BENCHMARK_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def secret_spans_sql() -> str:
    """Matches by splitting, places by running sums, links by running values, as the operator has them."""
    lower = LOWER.format("text")
    patterns = {k: p.replace("(?i:", "(?:").replace("'", "''") for k, p in secrets.PATTERNS.items()}
    source = {k: lower if k in ("assign", "ident") else "text" for k in patterns}
    matches = "\n  UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, string_split_regex({source[k]}, '{p}') AS g, regexp_extract_all({source[k]}, '{p}', 1) AS w, "
        f"regexp_extract_all({source[k]}, '{p}', 2) AS v FROM d"
        for k, p in patterns.items()
    )

    def in_scope(*kinds: str) -> str:
        part = "kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"
        return (
            f"(coalesce(max(CASE WHEN {part} THEN stop END) OVER before >= start - {secrets.SCOPE}, false) OR "
            f"coalesce(min(CASE WHEN {part} THEN start END) OVER after <= stop + {secrets.SCOPE}, false))"
        )

    order = "PARTITION BY r ORDER BY start, stop, kind ROWS BETWEEN"
    number = "list_position([" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "], kind)"
    written = "string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, no{})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({matches}),
e AS (SELECT r, kind, unnest(range(1, len(w) + 1)) AS i, g, w, v FROM m),
l AS (SELECT r, kind, i, length(g[i]) AS gap, length(w[i]) AS len, length(v[i]) AS value FROM e),
p AS (SELECT r, kind, value, len, CAST(sum(gap + len) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM l),
c AS (SELECT r, CASE WHEN kind = 'assign' AND value < {secrets.MIN_SECRET} THEN 'weak' ELSE kind END AS kind, stop - len AS start, stop
  FROM p WHERE kind <> 'assign' OR value >= {secrets.MIN_WEAK}),
s AS (SELECT *, {in_scope("access", "ident")} AS identified, {in_scope("assign", "hex", "weak")} AS secret, {in_scope("endpoint")} AS addressed
  FROM c WINDOW before AS ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), after AS ({order} 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT r, kind, start, stop, {number} AS no FROM s
  WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'weak' AND (identified OR addressed)) OR (kind IN ('ident', 'endpoint') AND secret)),
t AS (SELECT r, count(*) FILTER (no = 1) AS n_assign, count(*) FILTER (no = 2) AS n_access, count(*) FILTER (no = 3) AS n_hex,
  {written.format("")} FILTER (no <= 3) AS base, {written.format("")} AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


#: CRC-32 of a text of ASCII characters, byte by byte with the usual table.
CRC_TABLE = """(SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256)))"""
CRC = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)))"

ORACLES: dict[str, str] = {
    "op1_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     m AS (SELECT *, role || chr(10) || text || chr(10) AS whole, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
                  regexp_replace(role || text, '[\\<\[]', 'xx', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(whole, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(length(escaped) + length('<|im_start|><|im_sep|><|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op4_jaccard": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
     v AS (SELECT r, list_slice(w, k + 1, k + 5) AS s FROM (SELECT r, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
     s AS (SELECT DISTINCT r, s FROM v),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.r <> b.r GROUP BY a.r, b.r),
     l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
     c(r, e) AS (SELECT r, r FROM d UNION SELECT c.r, l.y FROM c JOIN l ON l.x = c.e),
     m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.e GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op5_secrets": secret_spans_sql(),
    "op6_decontamination": f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {BENCHMARK_WORDS} AS w FROM benchmark),
     v AS (SELECT item_id, w, least(13, len(w)) AS s, unnest(range(0, greatest(1, len(w) - 12))) AS k FROM i WHERE len(w) > 0),
     iw AS (SELECT DISTINCT item_id, s, list_slice(w, k + 1, k + s) AS win FROM v),
     d AS (SELECT row_number() OVER () AS r, doc_id, {BENCHMARK_WORDS} AS w FROM documents),
     dv AS (SELECT r, w, s, unnest(range(0, len(w) - s + 1)) AS k FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s),
     dw AS (SELECT r, s, k, list_slice(w, k + 1, k + s) AS win FROM dv),
     occ AS (SELECT r, k, s, item_id FROM dw JOIN iw USING (s, win)),
     hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + s)) AS p FROM occ) GROUP BY r),
     its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op12_forest": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
     v AS (SELECT r, list_slice(w, k + 1, k + 3) AS s FROM (SELECT r, w, unnest(range(0, greatest(1, len(w) - 2))) AS k FROM d WHERE len(w) > 0)),
     s AS (SELECT DISTINCT r, s FROM v),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.r <> b.r GROUP BY a.r, b.r),
     l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
     c(r, e) AS (SELECT r, r FROM d UNION SELECT c.r, l.y FROM c JOIN l ON l.x = c.e),
     m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.e GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op13_tries": f"""
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
     t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS k FROM o),
     c AS (SELECT conv_id, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), {CRC_TABLE}),
     r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h
           UNION ALL SELECT conv_id, k, role, text FROM c JOIN t USING (conv_id) WHERE k > h),
     p AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(octet_length(encode(role)) || ':' || role || text), ',') OVER w AS path,
             octet_length(encode(text)) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
     m AS (SELECT conv_id, d, path, CASE WHEN d > 1 THEN left(path, 65 * (d - 1) - 1) ELSE '' END AS above, bytes FROM p
           UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
     n AS (SELECT path, min(d) AS depth, min(conv_id) AS conv_id, min(above) AS above, count(*) AS n_convs, min(bytes) AS bytes FROM m GROUP BY path),
     e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
           FROM (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) JOIN m USING (conv_id, d) GROUP BY path),
     k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
     w AS (SELECT path, n_convs, bytes, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
     u AS (SELECT unnest(range(0, depth + 1)) AS up, path, depth FROM n),
     s AS (SELECT CASE WHEN up = 0 THEN '' ELSE left(u.path, 65 * up - 1) END AS path, count(*) FILTER (w.n_children = 0) AS n_leaves,
             CAST(sum((w.n_convs - 1) * w.bytes) AS BIGINT) AS saved_tokens FROM u JOIN w ON w.path = u.path GROUP BY 1)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN w USING (path) JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n a ON a.path = n.above""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
     g AS (SELECT payload_digest, min(page_id) AS smallest FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN smallest IS NULL OR page_id IS NOT DISTINCT FROM smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)""",
}
