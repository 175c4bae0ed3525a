"""One query for each operator of this subpackage over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, decontamination, filter_audit, fingerprints, licenses, media, packing, periodic_runs, secret_scan, simhash_dedup, toxicity, warc
from gridloom.llm.shared import table

VOCABULARY = "word_bpe_49k.json"
#: Categories in the order of the chain, as conditions over labels.
CATEGORIES = {"low_quality": "quality = 0", "severe": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels"), CATEGORIES), keep=["doc_id"])


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.write_captures(table(spark, sf_dir, "pages"))
    return warc.read(warc.deduplicate(captures)).drop("url")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.detect(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_ownership, op2_mixture_packing, op3_toxicity_chain, op4_prefix_bpe, op5_simhash_fingerprints, op6_media_columns, op7_prefix_targets, op8_warc_revisits, op9_license_scan, op10_simhash_dedup, op11_benchmark_decontamination, op12_filter_interaction, op13_periodic_runs, pipeline)
}

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

ORACLE_SQL = {
    "op7_prefix_targets": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|role|>' || {_ESCAPED.format("role")} || '<|text|>' || {_ESCAPED.format("text")} || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars,
            CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples
        FROM turns GROUP BY conv_id""",
    "op8_warc_revisits": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS original FROM t)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
        FROM d""",
    # Windows as texts: of ten words, or of all words of a shorter item. longest_match is the longest stretch of one item's words.
    "op11_benchmark_decontamination": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
        wanted AS (SELECT item, w, j, n, array_to_string(w[j:j + n - 1], ' ') AS words FROM windows),
        sizes AS (SELECT DISTINCT n FROM wanted),
        places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
        met AS (SELECT p.r, p.i, p.n, p.w, x.item, x.w AS iw, x.j FROM (SELECT r, i, n, w, array_to_string(w[i:i + n - 1], ' ') AS words FROM places) p JOIN wanted x USING (n, words)),
        hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM met) GROUP BY r),
        held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM met) GROUP BY r),
        far AS (SELECT r, max(len(list_filter(range(0, least(len(w) - i, len(iw) - j) + 1), lambda t: w[i:i + t] = iw[j:j + t]))) AS longest FROM met GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
        FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r) LEFT JOIN far USING (r)""",
    "op12_filter_interaction": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM t),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(copy, FALSE)} AS f,
                coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, [x FOR x IN ['A', 'B', 'C', 'D', 'E'] IF (x = 'A' AND f.A) OR (x = 'B' AND f.B) OR (x = 'C' AND f.C) OR (x = 'D' AND f.D) OR (x = 'E' AND f.E)] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, f),
        k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, s AS step, filter_order[s:s] AS x, filter_order[1:s - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS s)),
        e AS (SELECT s.*, part, n, good, toxic, list_contains(fails, x) AS fails_it, len(list_filter(fails, lambda y: contains(before, y))) > 0 AS gone, fails = [x] AS alone FROM s, c),
        g AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT fails_it AND NOT gone) AS kept, sum(n) FILTER (fails_it AND NOT gone) AS removed, sum(n) FILTER (fails_it AND gone) AS redundant, sum(n) FILTER (alone) AS unique_fails,
                sum(good) FILTER (fails_it AND NOT gone) AS good_lost, sum(toxic) FILTER (fails_it AND NOT gone) AS toxic_lost FROM e GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM g""",
}
