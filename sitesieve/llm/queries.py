"""Registered queries of the operators, each over its whole tables, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from . import (
    decontaminate,
    exact_dedup,
    html_extract,
    license_scan,
    line_dedup,
    minhash_dedup,
    mix,
    prefix_trie,
    quality,
    simhash_dedup,
    spelling,
    url_reputation,
    warc,
)
from .common import hex16, table

# what the URL filter is asked to do: rules of the user, and the words in a URL that label its page as bad
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BAD_TERMS = ("adult", "casino", "pills", "spam")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(tune(spark), sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(tune(spark), sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(tune(spark), sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(tune(spark), sf_dir, "pages").select("page_id", "url")
    known = url_reputation.reputation(url_reputation.outcomes_by_terms(pages, BAD_TERMS))
    return url_reputation.judge(pages, known, URL_RULES).drop("url")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(tune(spark), sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = line_dedup.dropped_lines(table(tune(spark), sf_dir, "documents"), line_dedup.LEAST)
    return dropped.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = warc.archive(table(tune(spark), sf_dir, "pages"))
    return warc.read(index, path).drop("url")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix.mixed(table(tune(spark), sf_dir, "documents"))
    return chosen.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(table(tune(spark), sf_dir, "documents"))
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = prefix_trie.turns(table(tune(spark), sf_dir, "conversations"))
    return prefix_trie.nodes(*prefix_trie.with_shared_heads(placed))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.words(table(tune(spark), sf_dir, "documents")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(tune(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_exact_dedup,
        op3_quality_classifier,
        op4_url_filters,
        op5_license_scans,
        op6_decontamination,
        op7_line_dedup,
        op8_warc,
        op9_mixing,
        op10_simhash_dedup,
        op11_conversation_prefix_trie,
        op12_spelling_variants,
        op13_minhash_dedup,
    )
}

# CRC-32 of lists of bytes, table by table of its 256 steps
_CRC_TABLE = """
    crc AS (
        SELECT list(list_reduce([n] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS steps
        FROM range(256) r(n)
    )"""


def _crc(of_bytes: str) -> str:
    return f"xor(4294967295, list_reduce([4294967295] || ({of_bytes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d
    """,
    "op6_decontamination": r"""
        WITH t AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
        ), w AS (
            SELECT kind, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t
        ), item AS (
            SELECT id, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s, words
            FROM w WHERE kind = 'b' AND len(words) > 0
        ), win AS (
            SELECT DISTINCT id AS item_id, n, array_to_string(words[s:s + n - 1], ' ') AS win FROM item
        ), place AS (
            SELECT id, n, words, unnest(range(1, len(words) - n + 2)) AS s
            FROM w, (SELECT DISTINCT n FROM win) WHERE kind = 'd' AND len(words) >= n
        ), hit AS (
            SELECT p.id, p.s, p.n, item_id FROM (SELECT id, s, n, array_to_string(words[s:s + n - 1], ' ') AS win FROM place) p
            JOIN win USING (win, n)
        ), covered AS (
            SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY id
        ), items AS (
            SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
            FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY id
        )
        SELECT w.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered c ON w.id = c.id LEFT JOIN items i ON w.id = i.id WHERE kind = 'd'
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM g
    """,
    "op11_conversation_prefix_trie": f"""
        WITH {_CRC_TABLE}, said AS (
            SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item,
                   length(coalesce(text, '')) AS chars
            FROM conversations WHERE conv_id IS NOT NULL
        ), placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) - 1 AS pos, item, chars FROM said
        ), conv AS (
            SELECT conv_id, conv_id - conv_id % 100 AS opener,
                   {_crc("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))")} % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM placed), crc
        ), row_of AS (
            SELECT c.conv_id, p.pos, 0 AS own, item, chars FROM conv c JOIN placed p ON p.conv_id = c.opener AND p.pos < c.h
            UNION ALL SELECT c.conv_id, p.pos, 1, item, chars FROM conv c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h
        ), step AS (
            SELECT conv_id, row_number() OVER w AS depth, chars, sha256(string_agg(item, ',') OVER w) AS node
            FROM row_of WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT conv_id, 0, 0, 'root' FROM conv
        ), member AS (
            SELECT *, lag(node) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM step
            WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
        ), node AS (
            SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM member GROUP BY node
        ), child AS (SELECT parent AS node, count(*) AS n_children FROM node GROUP BY parent),
        below AS (
            SELECT m.node, sum((w.n - 1) * w.chars) AS saved, count(*) FILTER (c.node IS NULL) AS leaves
            FROM node w JOIN member m ON m.conv_id = w.conv_id AND m.depth <= w.depth LEFT JOIN child c ON c.node = w.node GROUP BY m.node
        )
        SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs,
               CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
               v.ends_sha256
        FROM node v JOIN below USING (node) LEFT JOIN child USING (node) LEFT JOIN node p ON p.node = v.parent
    """,
    "op12_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE}, run AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents
        ), counted AS (SELECT doc_id, run, count(*) AS c FROM run WHERE length(run) >= 6 GROUP BY ALL),
        coded AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM counted),
        marked AS (
            SELECT run, c, {_crc("list_transform(range(length(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT))")} AS h FROM coded, crc
        ), word AS (
            SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM marked
            ) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
        ), less AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM word)
        ), near AS (
            SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT l.word, w.word FROM less l JOIN word w ON w.word = l.rest
            UNION SELECT w.word, l.word FROM less l JOIN word w ON w.word = l.rest
        ), ranked AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n, count(*) OVER (PARTITION BY a.word) AS n_near,
                   row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, encode(b.word)) AS place
            FROM near JOIN word a ON a.word = near.word JOIN word b ON b.word = near.near
        ), form AS (SELECT word, near AS form, near_n AS form_n FROM ranked WHERE place = 1 AND near_n >= 5 * n),
        path AS (
            SELECT word, form AS onto FROM form UNION SELECT path.word, form.form FROM path JOIN form ON form.word = path.onto
        ), root AS (SELECT word, onto AS root FROM path WHERE onto NOT IN (SELECT word FROM form))
        SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
        FROM word w LEFT JOIN form USING (word) LEFT JOIN root USING (word) LEFT JOIN (SELECT word, n_near FROM ranked WHERE place = 1) USING (word)
    """,
    "op13_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS shingles
            FROM w WHERE len(words) > 0
        ), n AS (SELECT doc_id, len(shingles) AS n FROM s),
        g AS (SELECT doc_id, n, hash(sh) AS sh FROM (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS sh FROM s)),
        link AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v
        ), least AS (SELECT u AS doc_id, min(v) AS v FROM reach GROUP BY u)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(v, doc_id)) AS component_id,
               doc_id = least(doc_id, coalesce(v, doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
}
