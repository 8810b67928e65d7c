"""The registered queries, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    byte_bpe, conversation_trie, dedup, fingerprints, jaccard_join, licenses, main_text, packing, pitman_yor,
    secret_scan, spelling, toxicity, warc,
)
from fleetlens.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a ZIP-packaged WARC archive and back."""
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component over links of at least 80 percent."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and its neighbour's."""
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """The chain over what the labels tell: low quality first, then toxicity."""
    return toxicity.fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and the decision."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence statements in its text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the equal text that stays."""
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path)
    return byte_bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the model learnt from four fifths of them."""
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each with the opening that its number borrows."""
    return conversation_trie.prefix_trie(
        conversation_trie.sequences(table(spark, sf_dir, "conversations"), group=20, openings=4))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spans of secrets in its text."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the commoner form it is a variant of."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_packing, op3_jaccard_join, op4_fingerprints, op5_toxicity, op6_licenses, op7_exact_dedup, op8_byte_bpe, op9_lm_scores, op10_main_text, op11_prefix_trie, op12_secrets, op13_spelling)
}


def _crc32(x: str) -> str:
    """SQL of the unsigned CRC-32 of a text, bit by bit."""
    bits = (f"flatten(list_transform(range(octet_length(encode({x}))), lambda i: list_transform(range(8), lambda j: "
            f"(('0x' || hex(encode({x}))[2*i+1:2*i+2])::BIGINT >> j) & 1)))")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), "
            "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)")

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                     sha1(html) AS payload_digest,
                     CASE WHEN strlen(html) >= 1000
                          THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep
              FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM q""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')
                          AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
    # turns are ordered by number, then by role and text
    "op11_prefix_trie": rf"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, t.pos, t.role, t.text, 0 AS own FROM c JOIN t
                ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= h
              UNION ALL SELECT c.conv_id, t.pos, t.role, t.text, 1 FROM c JOIN t USING (conv_id) WHERE t.pos > h),
        s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM r),
        m AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                md5(string_agg(sha256(role) || sha256(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS node
              FROM s UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
        p AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ended
              FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
        n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(words) AS words,
                min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
              FROM p GROUP BY node),
        k AS (SELECT parent, count(*) AS children FROM n GROUP BY parent),
        a AS (SELECT n.*, coalesce(children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
        u AS (SELECT m.node, count(*) FILTER (a.n_children = 0) AS n_leaves,
                CAST(sum((a.n_convs - 1) * a.words) AS BIGINT) AS saved_tokens
              FROM a JOIN m ON m.conv_id = a.conv_id AND m.d <= a.depth GROUP BY m.node)
        SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, u.n_leaves,
               u.saved_tokens, a.ends AS ends_sha256
        FROM a JOIN u USING (node) LEFT JOIN a AS b ON b.node = a.parent""",
}
