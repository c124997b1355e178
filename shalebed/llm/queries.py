"""The queries of this subpackage, one for each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from . import bpe, chat, decontaminate, html_text, kneser_ney, near_dedup, passages, quality, sharding, url_filters


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; never a part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40, scratch(spark, "slot-map"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.filter(~held), scratch(spark, "kneser-ney"))
    return kneser_ney.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of three-word shingles with a similarity of 0.85 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that a smaller doc_id has."""
    out = passages.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), n=13)
    removed = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures of 2024; the day of the fetch follows from the page's id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 31 % 366 AS INT))").alias("fetched"))
    return url_filters.evaluate(pages, url_filters.list_table(spark)).withColumn("fetched", F.col("fetched").cast("string"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark items that they hold."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, written and opened again."""
    return quality.save_ledger(quality.ledger(table(spark, sf_dir, "documents")), scratch(spark, "ledger"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under the current policy."""
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.apply_policy(stored_ledger(spark, sf_dir)).select(*first, *quality.MEASURES[5:], "fail_mask", F.col("policy_version").cast("long").alias("policy_version"))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, by the stored ledger."""
    return quality.policies(stored_ledger(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and what only it rejects."""
    return quality.ablations(stored_ledger(spark, sf_dir))


def sharding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws of op1, checked over all documents."""
    out = op1_sharding(spark, sf_dir)
    each = out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    gapless = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    return each.agg(F.sum("n").alias("n_docs"), F.sum("b").alias("n_bytes"), F.bool_and(gapless).alias("gapless"), (F.max("shard") < 40).alias("within"))


def sharding_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 2 of the slot map, edited for one shard more, over all documents: a slot's records stay together in both versions."""
    out = sharding.grow(table(spark, sf_dir, "documents"), 40, 1, scratch(spark, "slot-map"))
    each = out.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b"), (F.min("before") == F.max("before")).alias("one"), (F.min("after") == F.max("after")).alias("other"), F.max("before").alias("before"), F.max("after").alias("after"))
    return each.agg(F.sum("n").alias("n_docs"), F.sum("b").alias("n_bytes"), F.bool_and(F.col("one") & F.col("other")).alias("together"), ((F.max("before") < 40) & (F.max("after") < 41)).alias("within"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_near_dedup": op3_near_dedup,
        "op4_chat": op4_chat,
        "op5_bpe": op5_bpe,
        "op6_passages": op6_passages,
        "op7_url_filters": op7_url_filters,
        "op8_html": op8_html,
        "op9_decontamination": op9_decontamination,
        "op10_quality": op10_quality,
        "quality_policies": quality_policies,
        "quality_ablations": quality_ablations,
        "sharding_summary": sharding_summary,
        "sharding_growth": sharding_growth,
    }


#: Words as RE2 sees them; [^\x20\x09-\x0D]+ of the contracts.
WORD = r"[^ \t\n\x0b\f\r]+"

#: The ledger by SQL.
LEDGER = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d
), g AS (
  SELECT rid, p, list_slice(words, p, p + 4) AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) >= 5)
), again AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p + o) AS n FROM again, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t\x0b\f\r]*[-*\u2022]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '([.][.][.]|\u2026)[ \t\x0b\f\r]*$')))::BIGINT AS n_cut_lines
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_upper > n_lower THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_digits > 20 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 256 ELSE 0 END)::BIGINT AS fail_mask FROM m
)
""".replace("\\u2022", "\u2022").replace("\\u2026", "\u2026")

OP10 = LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 AS base_failed,
       (fail_mask & 55) = 0 AS kept, n_lines, n_upper, n_lower, n_digits, n_bullet_lines, n_cut_lines, fail_mask, 2::BIGINT AS policy_version FROM f
"""

POLICIES = LEDGER + """
SELECT version AS policy_version, mask, count(*) FILTER (fail_mask & mask = 0) AS n_kept, count(*) FILTER (fail_mask & mask <> 0) AS n_rejected,
       count(*) FILTER (fail_mask & mask = 0 AND fail_mask & 55 <> 0) AS n_rescued FROM (VALUES (1, 3), (2, 55), (3, 511)) p(version, mask) LEFT JOIN f ON true GROUP BY ALL
"""

ABLATIONS = LEDGER + """
SELECT rule, count(*) FILTER (fail_mask & bit <> 0) AS n_failed, count(*) FILTER (fail_mask & 55 = bit) AS n_only
FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('word_length', 16), ('shouting', 32)) r(rule, bit) LEFT JOIN f ON true GROUP BY rule
"""

OP1 = "SELECT count(*) AS n_docs, sum(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS n_bytes, true AS {} , true AS {} FROM documents"

OP4 = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS ts FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, [struct_pack(role := role, text := text)] FROM t WHERE conv_id IS NULL
), p AS (
  SELECT DISTINCT list_slice(ts, 1, n) AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM c)
)
SELECT min(conv_id) AS conv_id, len(ts)::BIGINT AS n_turns,
       array_to_string(list_transform(ts, lambda x: '<|turn_start|>' || x.role || chr(10) || x.text || '<|turn_end|>'), chr(10)) AS text
FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = c.ts) GROUP BY ts
"""

OP7 = f"""
WITH e AS (
  SELECT * FROM (VALUES {", ".join(f"('{d}', '{a}', DATE '{day}', {seq})" for d, a, day, seq in url_filters.list_rows())}) t(domain, action, effective, seq)
), i AS (
  SELECT domain, action, effective AS since, lead(effective) OVER (PARTITION BY domain ORDER BY effective) AS until FROM e
), c AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 31 % 366)::INT AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host FROM pages
), m AS (
  SELECT c.*, i.domain, i.action, row_number() OVER (PARTITION BY page_id, url ORDER BY length(i.domain) DESC NULLS LAST) AS r
  FROM c LEFT JOIN i ON (host = domain OR ends_with(host, '.' || domain)) AND action <> 'remove' AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT page_id, url, host, CAST(fetched AS VARCHAR) AS fetched, domain AS matched, action, coalesce(action = 'block', false) AS blocked FROM m WHERE r = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": OP4, "op7_url_filters": OP7, "op10_quality": OP10, "quality_policies": POLICIES, "quality_ablations": ABLATIONS,
        "sharding_summary": OP1.format("gapless", "within"), "sharding_growth": OP1.format("together", "within"),
    }
