"""The queries of this subpackage with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, chat, decontaminate, lattice_lm, license_scan, line_dedup, near_dup, prefix_trie, private_data, quality_ranking, quality_rules, source_divergence, token_counts
from tributary.session import written_once

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    model = token_counts.token_column(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.digests(chat.windows(turns.unionByName(own), tokens=lambda text: model(text) + chat.MARKS))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(documents(spark, sf_dir)).select("doc_id", "text", "lines_in", "lines_removed")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocabulary = bpe.with_lexicon(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(docs, vocabulary)


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written_once(quality_ranking.described(documents(spark, sf_dir)))  # every text once
    labels = quality_ranking.learning_rows(table(spark, sf_dir, "labels"))
    scored = quality_ranking.ranked_described(found, quality_ranking.fit_described(found, labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find(documents(spark, sf_dir))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k.name) for k in private_data.BASE],
        F.sha2(private_data.span_list(F.col("base")), 256).alias("base_sha256"),
        private_data.span_list(F.concat("base", "added")).alias("spans"),
        private_data.score_list(F.concat("base", "added")).alias("scores"),
    )


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_private_data": op9_private_data,
    "op10_near_dup": op10_near_dup,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH cut AS (
            SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
        ), found AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM cut
        ), spread AS (
            SELECT bare, arg_min(doc_id, (doc_id, place)) AS first_id, arg_min(place, (doc_id, place)) AS first_at FROM found
            WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {line_dedup.SITES}
        ), told AS (
            SELECT doc_id, place, line, first_id IS NOT NULL AND (doc_id, place) <> (first_id, first_at) AS gone
            FROM found LEFT JOIN spread USING (bare)
        )
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
            count(*) AS lines_in, count(*) FILTER (WHERE gone) AS lines_removed FROM told GROUP BY doc_id
    """,
    "op12_prefix_trie": """
        WITH RECURSIVE turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), lengths AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
        ), crc(conv_id, step, v) AS (
            SELECT conv_id, 0, 4294967295::BIGINT FROM lengths
            UNION ALL
            SELECT conv_id, step + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (
                SELECT conv_id, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(conv_id::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE v END AS x
                FROM crc WHERE step < 8 * length(conv_id::VARCHAR)
            )
        ), taken AS (
            SELECT conv_id, conv_id - conv_id % 5 AS head, xor(v, 4294967295) % 9 AS h FROM crc WHERE step = 8 * length(conv_id::VARCHAR)
        ), rebuilt AS (
            SELECT p.conv_id, 0 AS own, pos, role, text FROM taken p JOIN turns t ON t.conv_id = p.head AND pos <= h
            UNION ALL
            SELECT p.conv_id, 1, pos, role, text FROM taken p JOIN turns t ON t.conv_id = p.conv_id AND pos > h
        ), listed AS (
            SELECT conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS turns
            FROM lengths LEFT JOIN rebuilt r USING (conv_id) GROUP BY conv_id
        ), member AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM listed)
        ), node AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends,
                coalesce(octet_length(encode(path[d].text)), 0) AS size FROM member GROUP BY path, d
        ), told AS (
            SELECT v.*, (SELECT count(*) FROM node c WHERE c.d = v.d + 1 AND c.path[1:v.d] = v.path) AS n_children FROM node v
        )
        SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, s.saved_tokens,
            sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM told v LEFT JOIN node p ON p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]
        JOIN (
            SELECT a.path, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.size)::BIGINT AS saved_tokens
            FROM told a JOIN told b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path, a.d
        ) s ON s.path = v.path AND s.d = v.d
    """,
    "op13_source_divergence": f"""
        WITH d AS (
            SELECT row_number() OVER () AS n_row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), found AS (
            SELECT n_row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT n_row) >= {source_divergence.LEAST_DOCS}
        ), counted AS (
            SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
        ), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), total AS (
            SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN counted USING (lang, source) GROUP BY lang, source
        ), shares AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v)::HUGEINT AS p
            FROM total JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
        ), whole AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v))::HUGEINT AS q
            FROM counted JOIN size USING (lang) GROUP BY lang, term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), both_parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {source_divergence.TOP}
    """,
}
