"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once for each text. The ledger holds the measurements and one integer
whose bit k says that rule k failed; it is stored under the version of the rules, and a stored
version is never changed. A policy is a versioned set of bits; applying one, comparing several
or taking one rule away (ablation) reads the stored ledger only, never a text. A row of the
ledger is tied to its document by two hashes of the text, which is all that rules look at.

Defined results: a null or empty text has no words and fails ``few_words``; rows with equal
or null doc_id are judged one by one; other columns are ignored; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from .words import WordHashes, chunks, content_key, mix, per_doc, windows, without_content, word_arrays

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bullet_lines", "n_cut_lines")
#: The version of RULES; a rule that is added or changed makes a new one.
RULES_VERSION = 2


#: Rule k is bit k and keeps it for good; new rules take new bits. A rule says what makes it
#: fail, for Spark columns as for NumPy arrays.
RULES = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("dup_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ("shouting", lambda m: m["n_upper"] > m["n_lower"]),
    ("digits", lambda m: 100 * m["n_digits"] > 20 * m["word_chars"]),
    ("bullets", lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"]),
    ("cut_lines", lambda m: 100 * m["n_cut_lines"] > 30 * m["n_lines"]),
)
BASE_MASK = 0b000011
#: What a bullet line begins with, and what a line that breaks off ends with.
BULLETS, CUT = (b"-", b"*", "\u2022".encode()), (b"...", "\u2026".encode())


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document."""

    version: int
    mask: int


#: Version 1 is the base rules. Version 2 leaves dup_lines to the ledger: on labelled rows it
#: rejected clean documents only. Version 3 is every rule, for comparison.
POLICIES = {1: Policy(1, 0b000011), 2: Policy(2, 0b110111), 3: Policy(3, 0b111111111)}
CURRENT = POLICIES[2]


def _tables() -> np.ndarray:
    """For each byte: begins a character of a word, is a symbol, is A-Z, is a-z, is a digit."""
    b = np.arange(256)
    space = (b == 0x20) | ((b >= 9) & (b <= 13))
    return np.stack([((b & 0xC0) != 0x80) & ~space, np.isin(b, list(b"#*$%&|<>")), (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)]).astype(np.uint8)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Slices of the batches with the measurements of their texts."""
    known, table = WordHashes(), _tables()
    for batch, texts in chunks(batches):
        hashes, lens = word_arrays(texts, known)
        at, h = windows(hashes, lens, 5)
        doc = np.repeat(np.arange(len(lens)), lens)
        _, inverse, counts = np.unique(h ^ mix(doc[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        change = np.zeros(len(hashes) + 1, np.int32)
        again = at[counts[inverse] > 1]
        np.add.at(change, again, 1)
        np.add.at(change, again + 5, -1)
        buffer, sizes = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        chars, symbols, upper, lower, digits = (per_doc(t[buffer], sizes) for t in table)
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
        filled = np.fromiter(map(len, lines), np.int64, len(lines))
        bullets = np.fromiter((sum(x.lstrip().startswith(BULLETS) for x in own) for own in lines), np.int64, len(lines))
        cut = np.fromiter((sum(x.rstrip().endswith(CUT) for x in own) for own in lines), np.int64, len(lines))
        dups = filled - np.fromiter((len(set(x)) for x in lines), np.int64, len(lines))
        yield batch, dict(zip(MEASURES, (lens, chars, symbols, dups, per_doc(np.cumsum(change)[:-1] > 0, lens), filled, upper, lower, digits, bullets, cut), strict=True))


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ["doc_id", "key_a", "key_b"]
    for batch, m in _measured(batches):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*own, *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the text's key, the measurements and fail_mask of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *content_key(text))
    measured = rows.mapInArrow(_ledger, "doc_id long, key_a long, key_b long, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = F.lit(0).cast("long")
    for bit, (_, failed) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(failed(measured), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_mask", mask)


def save_ledger(ledger: DataFrame, path: str, version: int = RULES_VERSION) -> DataFrame:
    """Stores the ledger under the version of its rules and opens it; a version that exists is an error."""
    ledger.write.mode("error").parquet(f"{path}/rules={version}")
    return open_ledger(ledger.sparkSession, path, version)


def open_ledger(spark: SparkSession, path: str, version: int = RULES_VERSION) -> DataFrame:
    return spark.read.parquet(f"{path}/rules={version}")


def apply_policy(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return ledger.withColumns({
        "base_failed": F.col("fail_mask").bitwiseAND(F.lit(BASE_MASK)) != 0,
        "kept": F.col("fail_mask").bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0,
        "policy_version": F.lit(policy.version),
    })


def ablations(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it rejects.

    One aggregation by mask leaves at most 2^rules rows; all ablations come from these.
    """
    masks = ledger.groupBy(F.col("fail_mask").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    bits = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if policy.mask >> k & 1]
    sums = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(b)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("m") == b, F.col("n"))), F.lit(0)).alias("n_only")) for name, b in bits]
    return masks.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def policies(ledger: DataFrame) -> DataFrame:
    """(policy_version, mask, n_kept, n_rejected, n_rescued): each policy beside the current one; rescued are kept by it and not by the current one."""
    masks = ledger.groupBy("fail_mask").agg(F.count("*").alias("n"))
    now = F.col("fail_mask").bitwiseAND(F.lit(CURRENT.mask | BASE_MASK)) != 0
    sums = []
    for p in POLICIES.values():
        bad = F.col("fail_mask").bitwiseAND(F.lit(p.mask | BASE_MASK)) != 0
        add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        sums.append(F.struct(F.lit(p.version).alias("policy_version"), F.lit(p.mask | BASE_MASK).alias("mask"), add(~bad).alias("n_kept"), add(bad).alias("n_rejected"), add(~bad & now).alias("n_rescued")))
    return masks.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def keep_good(docs: DataFrame, policy: Policy = CURRENT, path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that the policy keeps by the stored ledger at ``path`` (a new one if none is given)."""
    led = save_ledger(ledger(docs), path or scratch(docs.sparkSession, "ledger"))
    return without_content(docs, apply_policy(led, policy).filter("NOT kept").select("key_a", "key_b").distinct())
