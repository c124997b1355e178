"""Every query of the engine by name, and the SQL that gives the same rows.

The lines of ``documents`` are the archive that most queries run over: written once for each
session and folder, with its index, then read like any other archive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytes as B
from .functions import codec
from .operators import chunks, detection, genome, index, search, templates, transforms, vectors
from .options import preset
from .sources import archive, chunk_store, files, raw
from .sources.lines import lines_of, running_offsets, split_lines
from .storage import scratch
from .streaming import ingest

BLOCK = 256
OPTIONS = preset("search_optimized").with_(block_size=BLOCK)
TERM, PHRASE, SHORT = "ion", "the and", "ß"
SMALL_CHUNK = 64
_archives: dict[tuple[str, str], archive.Archive] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(documents(spark, sf_dir), BLOCK)


def opened(spark: SparkSession, sf_dir: str) -> archive.Archive:
    """The session's archive of the documents' lines."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _archives:
        _archives[key] = archive.write(lines(spark, sf_dir), scratch(spark, "archive"), OPTIONS)
    return _archives[key]


def forget() -> None:
    """Lets the next query write the archive anew."""
    _archives.clear()


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", B.payload(F.col("text")).alias("data"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of the similarity searches: the vector of the smallest id."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


def rounded(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = f"""
WITH src AS (
  SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS t FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM src
), lines AS (
  SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no, (row_number() OVER (ORDER BY doc_id, pos) - 1) // {BLOCK} AS block_id FROM split
)
"""
HEX = """
WITH raw AS (
  SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL
), bytes AS (
  SELECT doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS b FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM raw)
)
"""


@query(LINES + "SELECT doc_id, line_no, block_id, pos, line FROM lines")
def lines_split(spark, sf_dir):
    return lines(spark, sf_dir)


@query(LINES + f"SELECT line_no, block_id, line FROM lines WHERE contains(line, '{TERM}')")
def search_contains(spark, sf_dir):
    return opened(spark, sf_dir).search(TERM).select("line_no", "block_id", "line")


@query(LINES + f"SELECT count(*) AS n_lines FROM lines WHERE contains(line, '{TERM}')")
def count_matches(spark, sf_dir):
    return opened(spark, sf_dir).count(TERM)


@query(LINES + f"SELECT line_no, line FROM lines WHERE contains(line, '{PHRASE}')")
def search_phrase(spark, sf_dir):
    return opened(spark, sf_dir).search(PHRASE).select("line_no", "line")


@query(LINES + f"SELECT line_no, line FROM lines WHERE contains(line, '{SHORT}')")
def search_short_term(spark, sf_dir):
    return opened(spark, sf_dir).search(SHORT).select("line_no", "line")


@query(LINES + "SELECT line_no, line FROM lines WHERE contains(line, 'License')")
def search_selective(spark, sf_dir):
    return opened(spark, sf_dir).search("License").select("line_no", "line")


@query(LINES + "SELECT count(*) AS n_lines FROM lines WHERE contains(line, 'zzqzz')")
def search_absent(spark, sf_dir):
    return opened(spark, sf_dir).count("zzqzz")


@query(LINES + f"SELECT line_no, md5(line) AS line_md5 FROM lines WHERE contains(line, '{TERM}')")
def search_bytes(spark, sf_dir):
    return opened(spark, sf_dir).search_bytes(TERM.encode()).select("line_no", F.md5("line").alias("line_md5"))


@query(LINES + f"SELECT line_no, line FROM lines WHERE contains(line, '{TERM}') ORDER BY line_no LIMIT 100")
def search_limit(spark, sf_dir):
    return opened(spark, sf_dir).first(TERM, 100).select("line_no", "line")


@query(LINES + f"SELECT least(count(*), 100)::BIGINT AS shown, greatest(count(*) - 100, 0)::BIGINT AS further FROM lines WHERE contains(line, '{TERM}')")
def search_further(spark, sf_dir):
    return opened(spark, sf_dir).limited(TERM, 100)


@query(LINES + f"SELECT line_no, left(line, instr(line, '{TERM}') - 1) || '[{TERM}]' || substr(line, instr(line, '{TERM}') + {len(TERM)}) AS marked FROM lines WHERE contains(line, '{TERM}')")
def search_highlight(spark, sf_dir):
    return opened(spark, sf_dir).search(TERM).select("line_no", search.highlighted(F.col("line"), TERM).alias("marked"))


@query(LINES + "SELECT line_no, block_id, line FROM lines WHERE line_no = 777")
def get_row(spark, sf_dir):
    return opened(spark, sf_dir).get_row(777).select("line_no", "block_id", "line")


@query(LINES + "SELECT line_no, line FROM lines WHERE line_no BETWEEN 500 AND 1500")
def get_rows(spark, sf_dir):
    return search.get_rows(opened(spark, sf_dir).lines, 500, 1500).select("line_no", "line")


@query(LINES + "SELECT line_no, line FROM lines WHERE block_id = 2")
def block_scan(spark, sf_dir):
    return search.block_scan(opened(spark, sf_dir).lines, 2).select("line_no", "line")


@query(LINES + "SELECT block_id, min(line_no) AS first_line, count(*) AS line_count, sum(octet_length(encode(line)) + 1)::BIGINT AS raw_bytes FROM lines GROUP BY block_id")
def block_stats(spark, sf_dir):
    return opened(spark, sf_dir).blocks.select("block_id", "first_line", "line_count", "raw_bytes")


@query(LINES + "SELECT count(*) AS row_count, count(DISTINCT block_id) AS block_count, sum(octet_length(encode(line)) + 1)::BIGINT AS raw_bytes FROM lines")
def archive_stats(spark, sf_dir):
    return opened(spark, sf_dir).stats()


@query(LINES + "SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY doc_id")
def reconstruct_doc(spark, sf_dir):
    return search.reconstruct(opened(spark, sf_dir).lines, "doc_id")


@query(LINES + "SELECT block_id, count(DISTINCT word) AS n_words FROM (SELECT block_id, unnest(regexp_extract_all(line, '[A-Za-z0-9_]{3,}')) AS word FROM lines) GROUP BY block_id")
def word_tokens_per_block(spark, sf_dir):
    return index.block_words(lines(spark, sf_dir)).groupBy("block_id").agg(F.count("*").alias("n_words"))


GRAMS = LINES + """, words AS (
  SELECT DISTINCT block_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT block_id, unnest(regexp_extract_all(line, '[A-Za-z0-9_]{3,}')) AS w FROM lines)
), grams AS (
  SELECT DISTINCT block_id, substr(w, i, 3) AS g FROM (SELECT block_id, w, unnest(range(1, length(w) - 1)) AS i FROM words)
)
"""


@query(GRAMS + "SELECT block_id, count(*) AS n_grams FROM grams GROUP BY block_id")
def trigram_distinct_per_block(spark, sf_dir):
    return opened(spark, sf_dir).blocks.select("block_id", index.n_trigrams().alias("n_grams")).filter("n_grams > 0")


@query(GRAMS + "SELECT block_id // 4 AS group_id, count(DISTINCT g) AS n_grams FROM grams GROUP BY 1")
def bitmap_merge(spark, sf_dir):
    return index.merged(opened(spark, sf_dir).blocks, F.expr("block_id DIV 4")).select("group_id", index.n_trigrams().alias("n_grams"))


@query(GRAMS + "SELECT block_id FROM grams WHERE g IN ('lic', 'ice', 'cen', 'ens', 'nse') GROUP BY block_id HAVING count(*) = 5")
def candidate_blocks(spark, sf_dir):
    return search.candidates(opened(spark, sf_dir).blocks, "License")


@query(LINES + """, own AS (SELECT row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS nth, text FROM conversations)
SELECT line_no, line FROM lines UNION ALL SELECT m.n + own.nth, coalesce(own.text, '') FROM own CROSS JOIN (SELECT count(*) AS n FROM lines) m""")
def append_lines(spark, sf_dir):
    a = archive.write(lines(spark, sf_dir).drop("doc_id", "pos"), scratch(spark, "appended"), OPTIONS)
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("line")).withColumn("n", F.lit(1))
    a.append(running_offsets(told, ["conv_id", "turn", "line"], "n").select(F.col("start").alias("line_no"), "line"))
    return a.lines.select("line_no", "line")


def docs_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' files only: a stream can't read a single file."""
    at = scratch(spark, "arrivals")
    documents(spark, sf_dir).write.parquet(at)
    return at


@query("""WITH own AS (SELECT source, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS n_lines FROM own WHERE contains(line, 'ion') GROUP BY source""")
def stream_archive_search(spark, sf_dir):
    """An archive that a stream has written, opened and searched."""
    docs = documents(spark, sf_dir)
    at = scratch(spark, "streamed")
    rows = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").format("parquet").load(docs_folder(spark, sf_dir)).filter("text IS NOT NULL")
    ingest.ingest(rows.select("source", F.explode(split_lines(F.col("text"))).alias("line")), f"{at}/archive", f"{at}/checkpoint", BLOCK, once=True).awaitTermination()
    return archive.Archive(spark, f"{at}/archive").search(TERM).groupBy("source").agg(F.count("*").alias("n_lines"))


@query(LINES + """, named AS (SELECT block_id, unnest(regexp_extract_all(line, '[A-Za-z0-9_]{3,}')) AS w FROM lines) SELECT DISTINCT block_id FROM named WHERE w = 'License'""")
def word_candidates(spark, sf_dir):
    """Blocks that have a whole word, by the archive's table of words."""
    path = scratch(spark, "words")
    index.write_words(opened(spark, sf_dir).lines, path)
    return index.word_candidates(spark, path, ["License"])


@query(LINES + "SELECT block_id, count(*) AS n_lines, sum(octet_length(encode(line)) + 1)::BIGINT AS raw_bytes FROM lines GROUP BY block_id")
def block_payloads(spark, sf_dir):
    """Blocks as frames, opened again."""
    frames = opened(spark, sf_dir).payloads()
    text = F.decode(codec.decompressed(F.col("payload")), "UTF-8")
    return frames.select("block_id", "raw_bytes", (F.size(F.split(text, "\n", -1)) - 1).cast("long").alias("n_lines"))


COSINE = "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) AS score FROM embeddings, q) "


@query(COSINE + "SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.2")
def cosine_threshold(spark, sf_dir):
    return vectors.above(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 0.2, "vec_id").select("vec_id", rounded("score"))


@query(COSINE + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return vectors.top(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id").select("vec_id", rounded("score"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalized(vectors.doubles(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT label, i::INTEGER AS i, round(sum(x), 4) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, i")
def sketch_merge(spark, sf_dir):
    return vectors.merged(table(spark, sf_dir, "embeddings"), "label").select("label", "i", rounded("x", 4))


@query(LINES + ", q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS block_id, list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) AS score FROM embeddings, q) SELECT block_id, round(max(score), 6) AS score, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM s JOIN lines USING (block_id) WHERE score >= 0 GROUP BY block_id")
def search_similar_with_lines(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "block_id")
    found = vectors.above(own, first_vector(spark, sf_dir), 0.0, "block_id")
    return vectors.with_lines(found, opened(spark, sf_dir).lines).select("block_id", rounded("score"), F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def matrix_sql(columns) -> str:
    """A matrix as a list of its columns."""
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in c) + "]" for c in columns) + "]::DOUBLE[][]"


#: The sketches of the embeddings: normalised, times the fixed rotation, on a grid of 16 steps.
CODES = f"""WITH r AS (SELECT {matrix_sql(vectors.rotation(64).T)} AS r),
unit AS (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
codes AS (SELECT vec_id, norm, list_transform(r, lambda c: least(greatest(floor((list_inner_product(u, c) * 8 + 3) / 0.375), 0), 15)) AS c FROM unit, r),
grid AS (SELECT vec_id, norm, c, list_transform(c, lambda x: -3 + 0.375 * (x + 0.5)) AS g FROM codes)
"""


@query(CODES + ", q AS (SELECT g AS h FROM grid ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(g, h), 6) AS score FROM grid, q ORDER BY list_cosine_similarity(g, h) DESC, vec_id LIMIT 10")
def quantized_topk(spark, sf_dir):
    sketches = vectors.quantize(table(spark, sf_dir, "embeddings"), 4, "vec_id")
    return vectors.quantized_top(sketches, first_vector(spark, sf_dir), 10, "vec_id").select("vec_id", rounded("score"))


@query(CODES + "SELECT vec_id, 36 AS stored_bytes, list_sum(c)::BIGINT AS code_sum, round(norm, 6) AS norm FROM codes")
def sketch_sizes(spark, sf_dir):
    sketches = vectors.quantize(table(spark, sf_dir, "embeddings"), 4, "vec_id")
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return sketches.select("vec_id", (F.octet_length("packed") + 4).alias("stored_bytes"), total.alias("code_sum"), rounded("norm"))


@query(CODES + ", q AS (SELECT g AS h, norm AS n FROM grid ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_inner_product(g, h) / 64 * grid.norm * n, 6) AS product FROM grid, q")
def quantized_products(spark, sf_dir):
    sketches = vectors.quantize(table(spark, sf_dir, "embeddings"), 4, "vec_id")
    norms, codes = vectors.quantize_array(np.asarray(first_vector(spark, sf_dir), np.float64)[None, :], 4)
    asked = F.array(*[F.lit(int(c)) for c in codes[0]])
    return sketches.select("vec_id", F.round(vectors.quantized_inner_product(F.col("norm"), F.col("codes"), F.lit(float(norms[0])), asked, 4), 6).alias("product"))


@query(LINES + ", b AS (SELECT DISTINCT block_id FROM lines), v AS (SELECT count(*) AS n FROM embeddings), " + CODES.removeprefix("WITH ") + """,
own AS (SELECT block_id, g FROM b, v JOIN grid ON grid.vec_id = block_id % v.n), q AS (SELECT g AS h FROM grid ORDER BY vec_id LIMIT 1)
SELECT block_id, round(list_cosine_similarity(g, h), 6) AS score FROM own, q ORDER BY list_cosine_similarity(g, h) DESC, block_id LIMIT 10""")
def similar_blocks(spark, sf_dir):
    """Blocks by the sketches that were attached to an archive: the embeddings, one after another and again."""
    a = archive.write(lines(spark, sf_dir).drop("doc_id", "pos"), scratch(spark, "sketched"), OPTIONS)
    own = table(spark, sf_dir, "embeddings")
    n = own.count()
    by_block = a.blocks.select("block_id", (F.col("block_id") % n).alias("vec_id")).join(own, "vec_id").select("block_id", "embedding")
    a.attach(by_block)
    return a.similar(first_vector(spark, sf_dir), k=10).select("block_id", rounded("score"))


@query(f"WITH m AS (SELECT {matrix_sql(vectors.signs(64, 32).T)} AS m), p AS (SELECT vec_id, list_transform(m, lambda c: list_inner_product(embedding::DOUBLE[], c) / sqrt(32)) AS p FROM embeddings, m) SELECT vec_id, round(sqrt(list_inner_product(p, p)), 6) AS length, round(p[1], 6) AS first FROM p")
def jl_project(spark, sf_dir):
    out = vectors.project(table(spark, sf_dir, "embeddings"), 32, "vec_id")
    return out.select("vec_id", F.round(vectors.norm(F.col("projected")), 6).alias("length"), F.round(F.col("projected")[0], 6).alias("first"))


ENTROPY = HEX + ", c AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY doc_id, b), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id) "


@query(ENTROPY + "SELECT raw.doc_id, coalesce(e.entropy, 0) AS entropy, coalesce(e.variety, 0)::INTEGER AS variety FROM raw LEFT JOIN (SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy, count(*) AS variety FROM c JOIN t USING (doc_id) GROUP BY doc_id) e USING (doc_id)")
def byte_entropy(spark, sf_dir):
    h = payloads(spark, sf_dir).filter("data IS NOT NULL").select("doc_id", B.histogram(F.col("data")).alias("h"))
    return h.select("doc_id", F.round(B.entropy(F.col("h")), 6).alias("entropy"), B.variety(F.col("h")).alias("variety"))


@query(HEX + """, hi AS (SELECT doc_id, b // 16 AS v, count(*) AS n FROM bytes GROUP BY ALL), lo AS (SELECT doc_id, b % 16 AS v, count(*) AS n FROM bytes GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS t FROM bytes GROUP BY doc_id)
SELECT doc_id, h.e AS high_entropy, l.e AS low_entropy FROM
(SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS e FROM hi JOIN t USING (doc_id) GROUP BY doc_id) h JOIN
(SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS e FROM lo JOIN t USING (doc_id) GROUP BY doc_id) l USING (doc_id)""")
def nibble_entropy(spark, sf_dir):
    h = payloads(spark, sf_dir).filter("octet_length(data) > 0").select("doc_id", B.histogram(F.col("data")).alias("h"))
    of = lambda high: F.round(B.entropy(B.nibbles(F.col("h"), high)), 6) + 0.0
    return h.select("doc_id", of(True).alias("high_entropy"), of(False).alias("low_entropy"))


RATIOS = HEX + """SELECT doc_id, round(avg(CASE WHEN chr(b) IN ('A','C','G','T','N','a','c','g','t','n') THEN 1.0 ELSE 0 END), 6) AS dna,
round(avg(CASE WHEN b BETWEEN 48 AND 57 THEN 1.0 ELSE 0 END), 6) AS digit, round(avg(CASE WHEN b IN (9, 10, 13) OR b BETWEEN 32 AND 126 THEN 1.0 ELSE 0 END), 6) AS textual,
round(avg(CASE WHEN b >= 128 THEN 1.0 ELSE 0 END), 6) AS high, round(avg(CASE WHEN b BETWEEN 32 AND 126 THEN 1.0 ELSE 0 END), 6) AS printable FROM bytes GROUP BY doc_id"""


@query(RATIOS)
def char_ratios(spark, sf_dir):
    h = payloads(spark, sf_dir).filter("octet_length(data) > 0").select("doc_id", B.histogram(F.col("data")).alias("h"))
    share = lambda values: F.round(B.counted(F.col("h"), values) / B.total(F.col("h")), 6)
    return h.select("doc_id", share(detection.BASES).alias("dna"), share(detection.DIGITS).alias("digit"), share(detection.TEXTUAL).alias("textual"), share(detection.HIGH).alias("high"), share(detection.PRINTABLE).alias("printable"))


SAMPLED = HEX + """, s AS (
  SELECT doc_id, count(*) AS n, avg(CASE WHEN chr(b) IN ('A','C','G','T','N','a','c','g','t','n') THEN 1.0 ELSE 0 END) AS dna, avg(CASE WHEN b BETWEEN 48 AND 57 THEN 1.0 ELSE 0 END) AS digit,
    avg(CASE WHEN b IN (9, 10, 13) OR b BETWEEN 32 AND 126 THEN 1.0 ELSE 0 END) AS textual, avg(CASE WHEN b >= 128 THEN 1.0 ELSE 0 END) AS high, avg(CASE WHEN b BETWEEN 32 AND 126 THEN 1.0 ELSE 0 END) AS printable,
    sum(CASE WHEN i < 256 AND b < 16 THEN 1 ELSE 0 END) AS zeros FROM bytes WHERE i < 4096 GROUP BY doc_id
), smart AS (
  SELECT raw.doc_id, raw.n AS size, CASE WHEN raw.n <= 256 THEN 'Text' WHEN dna > 0.90 THEN 'Dna' WHEN digit > 0.30 AND textual > 0.70 THEN 'Numeric'
    WHEN high > 0.20 OR textual < 0.80 THEN CASE WHEN zeros > 64 THEN 'StructuredBinary' ELSE 'Binary' END ELSE 'Text' END AS kind FROM raw LEFT JOIN s USING (doc_id)
)
"""


@query(SAMPLED + "SELECT doc_id, size, kind, size <= 32768 AS is_small FROM smart")
def smart_detect(spark, sf_dir):
    return detection.smart_detect(payloads(spark, sf_dir).filter("data IS NOT NULL"), "data").select("doc_id", "size", "kind", "is_small")


#: As many of the first bytes as the detectors look at decide; a byte entropy above 7.5 doesn't occur in texts.
DETECT = HEX + """, s AS (
  SELECT doc_id, count(*) AS n, avg(CASE WHEN chr(b) IN ('A','C','G','T','N','a','c','g','t','n') OR b IN (10, 13) THEN 1.0 ELSE 0 END) AS dna,
    avg(CASE WHEN b BETWEEN 48 AND 57 THEN 1.0 ELSE 0 END) AS digit, avg(CASE WHEN b BETWEEN 48 AND 57 OR b IN (44, 46, 45, 43, 10, 13) THEN 1.0 ELSE 0 END) AS numeric,
    avg(CASE WHEN b BETWEEN 32 AND 126 THEN 1.0 ELSE 0 END) AS printable FROM bytes WHERE i < 4096 GROUP BY doc_id
), hi AS (SELECT doc_id, b // 16 AS v, count(*) AS n FROM bytes WHERE i < 4096 GROUP BY ALL), lo AS (SELECT doc_id, b % 16 AS v, count(*) AS n FROM bytes WHERE i < 4096 GROUP BY ALL
), e AS (
  SELECT doc_id, abs(h.e - l.e) AS gap FROM (SELECT hi.doc_id, -sum(hi.n / s.n * log2(hi.n / s.n)) AS e FROM hi JOIN s USING (doc_id) GROUP BY hi.doc_id) h
  JOIN (SELECT lo.doc_id, -sum(lo.n / s.n * log2(lo.n / s.n)) AS e FROM lo JOIN s USING (doc_id) GROUP BY lo.doc_id) l USING (doc_id)
)
SELECT raw.doc_id, kind, CASE kind WHEN 'Dna' THEN 'dna_2bit' WHEN 'Numeric' THEN 'numeric_delta' WHEN 'Binary' THEN 'binary_delta' WHEN 'StructuredBinary' THEN 'nibble_split' ELSE 'none' END AS transform
FROM raw JOIN (SELECT raw.doc_id, CASE WHEN raw.n = 0 THEN 'Binary' WHEN dna > 0.90 THEN 'Dna' WHEN numeric > 0.70 AND digit > 0.3 THEN 'Numeric' WHEN printable >= 0.80 THEN 'Text'
  WHEN s.n >= 256 AND gap > 2.0 THEN 'StructuredBinary' ELSE 'Binary' END AS kind FROM raw LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id)) k USING (doc_id)"""


@query(DETECT)
def recommended_transform(spark, sf_dir):
    h = payloads(spark, sf_dir).filter("data IS NOT NULL").select("doc_id", B.histogram(B.sample(F.col("data"))).alias("h"))
    kinds = h.select("doc_id", detection.detect(F.col("h")).alias("kind"))
    return kinds.select("doc_id", "kind", detection.recommended_transform(F.col("kind")).alias("transform"))


#: The structure score of the first 4 KiB at each of some depths.
DEPTHS = """, x AS (SELECT doc_id, i, b, count(*) OVER w AS n, avg(b) OVER w AS m, stddev_pop(b) OVER w AS s FROM bytes WHERE i < 4096 WINDOW w AS (PARTITION BY doc_id)),
c AS (SELECT doc_id, k, CASE WHEN s < 1e-10 THEN NULL WHEN pow((i + 1) / n, k) < 1e-10 THEN (b - m) / s ELSE (b - m) / s / pow((i + 1) / n, k) END AS c FROM x, (SELECT unnest({depths}) AS k)),
a AS (SELECT doc_id, k, 3 * pi() * c / max(abs(c)) OVER (PARTITION BY doc_id, k) AS a FROM c),
scores AS (SELECT doc_id, k, coalesce(sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)), 1) AS score FROM a GROUP BY doc_id, k)
"""


@query(SAMPLED + DEPTHS.format(depths="[3]") + """, p AS (SELECT smart.doc_id, size, kind, CASE WHEN size <= 256 THEN 0 ELSE coalesce(score, 0) END AS score FROM smart LEFT JOIN scores USING (doc_id)),
q AS (SELECT *, score > 0.8 AS st, CASE WHEN kind = 'Dna' THEN 64 WHEN kind = 'Numeric' THEN 32 WHEN kind = 'Text' THEN CASE WHEN score > 0.8 THEN 128 ELSE 64 END WHEN kind = 'Random' THEN 0 ELSE 128 END * 1024 AS asked FROM p)
SELECT doc_id, size, kind, round(score, 5) AS score,
  CASE WHEN size <= 256 THEN 'none' WHEN size <= 32768 THEN CASE WHEN kind = 'Dna' THEN 'dna_fasta' WHEN st AND size > 512 THEN 'structured' WHEN kind = 'StructuredBinary' AND size > 512 THEN 'nibble_split' ELSE 'none' END
    WHEN kind = 'Dna' THEN 'dna_fasta' WHEN kind = 'Numeric' THEN 'numeric_delta' WHEN kind = 'StructuredBinary' THEN 'nibble_split' WHEN kind = 'Binary' THEN CASE WHEN st THEN 'structured' ELSE 'binary_delta' END ELSE 'none' END AS transform,
  CASE WHEN size <= 32768 THEN 1 WHEN kind IN ('Dna', 'Numeric') THEN 3 WHEN kind IN ('StructuredBinary', 'Binary') THEN 6 WHEN kind = 'Text' THEN CASE WHEN st THEN 6 ELSE 3 END ELSE 1 END AS level,
  CASE WHEN size <= 32768 OR asked = 0 THEN 0 ELSE greatest(least(asked, size // 4), 16384) END::BIGINT AS dictionary_bytes FROM q""")
def smart_policy(spark, sf_dir):
    own = payloads(spark, sf_dir).filter("data IS NOT NULL")
    return detection.smart_detect(own, "data").select("doc_id", "size", "kind", rounded("score", 5), "transform", "level", "dictionary_bytes")


@query(DETECT.replace("SELECT raw.doc_id, kind, CASE kind", "SELECT raw.doc_id, kind, CASE kind WHEN 'Dna' THEN 'mostly bases' WHEN 'Numeric' THEN 'mostly numbers' WHEN 'Text' THEN 'mostly printable' WHEN 'StructuredBinary' THEN 'halves of bytes differ' ELSE 'nothing else fits' END AS reason, CASE kind"))
def analyze(spark, sf_dir):
    """What a payload is, what it would be stored under, and why."""
    own = payloads(spark, sf_dir).filter("data IS NOT NULL")
    return detection.analyze(own, "data").select("doc_id", "kind", "transform", "reason")


@query("""WITH n AS (SELECT page_id, lower(url) AS n FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE WHEN ends_with(n, '.fa') OR ends_with(n, '.fna') OR ends_with(n, '.fasta') OR contains(n, 'dna') OR contains(n, 'genome') THEN 'Dna' WHEN ends_with(n, '.csv') OR ends_with(n, '.tsv') THEN 'Numeric'
WHEN regexp_matches(n, '[.](xls|xlsx|doc|docx|ppt|pptx|db|sqlite|mdb)$') THEN 'StructuredBinary' END AS kind FROM n""")
def detect_by_name(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    return pages.select("page_id", detection.by_name(F.col("url")).alias("kind"))


@query(HEX + """, c AS (SELECT doc_id, b, count(*) AS n FROM bytes WHERE i < 65536 GROUP BY doc_id, b), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id)
SELECT raw.doc_id, coalesce(e, 0) AS entropy, coalesce(v, 0)::INTEGER AS byte_variety FROM raw LEFT JOIN (SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS e, count(*) AS v FROM c JOIN t USING (doc_id) GROUP BY doc_id) x USING (doc_id)""")
def sampled_features(spark, sf_dir):
    return detection.features(payloads(spark, sf_dir).filter("data IS NOT NULL"), "data").select("doc_id", rounded("entropy"), "byte_variety")


@query()
def features(spark, sf_dir):
    return detection.features(payloads(spark, sf_dir), "data").select("doc_id", rounded("entropy"), rounded("lz_match_ratio"), "byte_variety", "kind", rounded("compressibility"), "recommended_level")


@query(HEX + DEPTHS.format(depths="[3]") + "SELECT doc_id, round(score, 5) AS score FROM scores JOIN (SELECT doc_id FROM x GROUP BY doc_id HAVING min(b) < max(b)) USING (doc_id)")
def structure_score(spark, sf_dir):
    h = payloads(spark, sf_dir).filter("octet_length(data) > 0").select("doc_id", B.structure_at(F.col("data")).alias("score"), B.variety(B.histogram(B.sample(F.col("data")))).alias("v"))
    return h.filter("v > 1").select("doc_id", rounded("score", 5))


@query(HEX + DEPTHS.format(depths=list(B.DEPTHS)) + ", r AS (SELECT doc_id, k, round(score, 5) AS score FROM scores) SELECT raw.doc_id, coalesce(max(r.score), 0) AS score FROM raw LEFT JOIN r USING (doc_id) GROUP BY raw.doc_id")
def structure_depths(spark, sf_dir):
    d = payloads(spark, sf_dir).filter("data IS NOT NULL").select("doc_id", B.depths(F.col("data"), B.DEPTHS).alias("ds"))
    return d.select("doc_id", F.round(B.best_depth(F.col("ds"))["score"], 5).alias("score"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey // 1024 AS block, o_custkey AS v, lag(o_custkey) OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IS NULL THEN v WHEN v >= p THEN 2 * (v - p) ELSE -2 * (v - p) - 1 END AS delta, v AS restored FROM o""")
def numeric_delta_zigzag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderkey DIV 1024").alias("block"))
    d = transforms.delta(o, "o_custkey", "block", "o_orderkey").drop("o_custkey")
    return transforms.undelta(d, "block", "o_orderkey", "restored").select("o_orderkey", "delta", "restored")


@query(HEX + """, d AS (SELECT doc_id, (b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0) + 256) % 256 AS d FROM bytes)
SELECT doc_id, sum(d)::BIGINT AS delta_sum, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zero, true AS same FROM d GROUP BY doc_id""")
def binary_delta(spark, sf_dir):
    d = payloads(spark, sf_dir).filter("octet_length(data) > 0").withColumn("d", transforms.binary_delta(F.col("data")))
    h = d.select("doc_id", B.histogram(F.col("d")).alias("h"), (transforms.binary_undelta(F.col("d")) == F.col("data")).alias("same"))
    total = F.aggregate(F.transform("h", lambda n, i: n * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return h.select("doc_id", total.alias("delta_sum"), F.col("h")[0].alias("n_zero"), "same")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, 8 + 2 * ((octet_length(encode(text)) + 1) // 2)::BIGINT AS nibble_bytes, substr(hex(encode(text)), 1, 1) AS first_half, true AS nibbles, true AS numbers, true AS fasta FROM documents WHERE text IS NOT NULL")
def transform_roundtrips(spark, sf_dir):
    p = payloads(spark, sf_dir).filter("data IS NOT NULL")
    again = {"nibbles": "nibble_split", "numbers": "numeric_delta", "fasta": "dna_fasta"}
    halves = p.withColumn("halves", transforms.apply(F.col("data"), "nibble_split"))
    return halves.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.octet_length("halves").cast("long").alias("nibble_bytes"), F.substring(F.hex(F.substring("halves", 9, 1)), 1, 1).alias("first_half"), *[(transforms.reverse(transforms.apply(F.col("data"), t), t) == F.col("data")).alias(k) for k, t in again.items()])


EVENT_MS = "epoch_us(ts) // 1000"


@query(f"""WITH e AS (SELECT event_id, {EVENT_MS} AS ms, lag({EVENT_MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, ms - p AS delta_ms, (CASE WHEN p IS NULL THEN 9 WHEN ms - p BETWEEN 1 AND 127 THEN 1 WHEN ms - p BETWEEN 0 AND 65535 THEN 3 WHEN ms - p BETWEEN -2147483648 AND 2147483647 THEN 5 ELSE 9 END)::INTEGER AS width FROM e""")
def timestamp_delta_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return transforms.timestamp_deltas(e, "ms", "user_id", ["ts", "event_id"]).select("event_id", "delta_ms", "width")


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS compact, epoch_ms(date_trunc('second', ts)) AS iso, epoch_ms(date_trunc('second', ts)) AS epoch FROM events")
def parse_timestamp_ms(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    said = {"compact": F.date_format(ts, "yyMMdd HHmmss"), "iso": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "epoch": F.unix_seconds(ts).cast("string")}
    return table(spark, sf_dir, "events").select("event_id", *[templates.parse_timestamp_ms(F.concat(s, F.lit(" x"))).alias(k) for k, s in said.items()])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of the events, which hold variables of every type."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    ip = F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7"))
    uuid = F.regexp_replace(F.md5(F.col("event_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    line = F.concat(ts, F.lit(" user "), F.col("user_id"), F.lit(" from "), ip, F.lit(" did "), F.col("event_type"), F.lit(" on /srv/data/"), F.col("event_type"), F.lit(".log id "), uuid, F.lit(" took "), F.format_string("%.3f", F.col("value")), F.lit("s code 0x"), F.lower(F.hex(F.col("event_id"))))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(f"event_id DIV {BLOCK}").alias("block_id"), "event_type", line.alias("line"))


#: What is left of an event's line where its variables were; the number before "s" has no end of its own.
EVENTS = f"WITH t AS (SELECT event_id AS line_no, event_id // {BLOCK} AS block_id, '<*> user <*> from <*> did ' || event_type || ' on <*> id <*> took ' || printf('%.3f', value) || 's code <*>' AS template FROM events) "


@query(EVENTS + "SELECT template, count(*) AS n, min(line_no) AS first_line FROM t GROUP BY template")
def template_mining(spark, sf_dir):
    return templates.mine(event_lines(spark, sf_dir))


@query()
def template_mining_documents(spark, sf_dir):
    return templates.mine(lines(spark, sf_dir).select("line_no", "block_id", "line"))


@query(EVENTS + "SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY first) - 1 AS template_id, template, n FROM (SELECT block_id, template, count(*) AS n, min(line_no) AS first FROM t GROUP BY ALL)")
def template_dictionary(spark, sf_dir):
    return templates.dictionary(event_lines(spark, sf_dir))


@query("SELECT event_id AS line_no, 6 AS n_vars, true AS same FROM events")
def template_roundtrip(spark, sf_dir):
    rows = templates.encoded(event_lines(spark, sf_dir)).withColumnRenamed("line", "was")
    return templates.decoded(rows).select("line_no", F.size("vars").alias("n_vars"), (F.col("line") == F.col("was")).alias("same"))


@query("SELECT unnest(['Timestamp', 'Integer', 'IpAddress', 'Path', 'Uuid', 'Hex']) AS type, count(*) AS n FROM events")
def var_types(spark, sf_dir):
    each = event_lines(spark, sf_dir).select(F.explode(templates.variables(F.col("line"))).alias("v"))
    return each.groupBy("v.type").agg(F.count("*").alias("n"))


DNA = "WITH d AS (SELECT doc_id, translate(regexp_replace(text, '[^ACGTNacgtn]', '', 'g'), 'acgtn', 'ACGTN') AS s FROM documents WHERE text IS NOT NULL) "


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of the documents that stand for bases."""
    return documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", genome.bases_of(F.col("text")).alias("bases"))


CODONS = DNA + ", c AS (SELECT doc_id, translate(substr(s, 3 * i + 1, 3), 'ACGTN', '01200') AS c FROM (SELECT doc_id, s, unnest(range(0, length(s) // 3)) AS i FROM d)), h AS (SELECT doc_id, (9 * substr(c, 1, 1)::INT + 3 * substr(c, 2, 1)::INT + substr(c, 3, 1)::INT) AS state, count(*) AS n FROM c GROUP BY ALL) "


@query(CODONS + "SELECT doc_id, state, n FROM h")
def codon_histogram(spark, sf_dir):
    return genome.codon_histogram(sequences(spark, sf_dir), "bases", "doc_id")


@query(CODONS + "SELECT doc_id, round(least(sqrt((sum(n * n) - 2 * sum(n) / 27 * sum(n) + 27 * pow(sum(n) / 27, 2)) / 27 / (pow(sum(n) / 27, 2) * 26)), 1), 6) AS score, arg_max(state, n * 100 + state) AS dominant FROM h GROUP BY doc_id")
def codon_score(spark, sf_dir):
    h = genome.codon_histogram(sequences(spark, sf_dir), "bases", "doc_id")
    return genome.codon_score(h, "doc_id").select("doc_id", rounded("score"), "dominant")


@query(DNA + "SELECT doc_id, substr(s, p + 1, 21) AS kmer, p::INTEGER AS pos FROM (SELECT doc_id, s, unnest(range(0, length(s) - 20, 8)) AS p FROM d WHERE length(s) >= 21) WHERE NOT contains(substr(s, p + 1, 21), 'N')")
def kmer_index(spark, sf_dir):
    return genome.kmer_index(sequences(spark, sf_dir), "bases", "doc_id")


@query("""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(ls, lambda l: starts_with(l, '>') OR starts_with(l, ';')))::BIGINT AS n_headers, list_max(list_transform(ls, lambda l: length(rtrim(l, chr(13)))))::BIGINT AS line_width,
  contains(text, chr(13) || chr(10)) AS crlf, len(regexp_extract_all(text, '[a-z]+'))::BIGINT AS n_lower_runs, len(regexp_extract_all(text, '[Nn]+'))::BIGINT AS n_runs_of_n FROM t""")
def sequence_metadata(spark, sf_dir):
    return genome.sequence_metadata(documents(spark, sf_dir).filter("text IS NOT NULL"), "text", "doc_id")


@query(DNA + "SELECT doc_id, p::INTEGER AS pos FROM (SELECT doc_id, s, unnest(range(0, length(s) - 20, 8)) AS p FROM d WHERE length(s) >= 21) WHERE substr(s, p + 1, 21) = (SELECT substr(s, 1, 21) FROM d WHERE length(s) >= 21 AND NOT contains(substr(s, 1, 21), 'N') ORDER BY doc_id LIMIT 1)")
def kmer_lookup(spark, sf_dir):
    """Places of one k-mer by an index that was saved and opened again."""
    path, s = scratch(spark, "kmers"), sequences(spark, sf_dir)
    genome.save_index(genome.kmer_index(s, "bases", "doc_id"), path)
    first = s.filter((F.length("bases") >= genome.K) & ~F.contains(F.substring("bases", 1, genome.K), F.lit("N"))).orderBy("doc_id").first()
    return genome.lookup(genome.open_index(spark, path), first["bases"][: genome.K]).select("doc_id", "pos")


RUNS = """WITH p AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]+|[^A-Z]+') AS parts FROM documents WHERE text IS NOT NULL)),
r AS (SELECT doc_id, part, length(part) AS length, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p) """


@query(RUNS + "SELECT doc_id, start, length::BIGINT AS length FROM r WHERE regexp_matches(part, '^[A-Z]')")
def rle_runs(spark, sf_dir):
    return genome.letter_runs(documents(spark, sf_dir), "text", "A-Z", "doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z]+|[^A-Z]+'))::INTEGER AS n_runs, true AS same FROM documents WHERE length(text) > 0")
def rle_roundtrip(spark, sf_dir):
    t = documents(spark, sf_dir).filter("length(text) > 0")
    bits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), "[A-Z]", "\u0001"), "[^\u0001]", "0"), "\u0001", "1")
    runs = t.withColumn("runs", transforms.runs(F.col("text"), "A-Z"))
    return runs.select("doc_id", F.size("runs.lengths").alias("n_runs"), (transforms.unruns(F.col("runs")) == bits).alias("same"))


@query(RUNS + "SELECT doc_id, 1000 AS pos FROM r WHERE regexp_matches(part, '^[A-Z]') AND 1000 >= start AND 1000 < start + length")
def run_membership(spark, sf_dir):
    points = documents(spark, sf_dir).select("doc_id", F.lit(1000).alias("pos"))
    return genome.in_runs(points, genome.letter_runs(documents(spark, sf_dir), "text", "A-Z", "doc_id"), "doc_id")


@query(DNA + "SELECT doc_id, length(s) AS n_bases, true AS same FROM d")
def reference_roundtrip(spark, sf_dir):
    s = sequences(spark, sf_dir)
    reference = (s.orderBy(F.desc(F.length("bases")), "doc_id").first() or [0, ""])[1].encode()
    own = s.withColumn("data", F.col("bases").cast("binary"))
    coded = own.withColumn("segments", genome.encode_against(F.col("data"), reference))
    return coded.select("doc_id", F.length("bases").cast("long").alias("n_bases"), (genome.decode_against(F.col("segments"), reference) == F.col("data")).alias("same"))


@query()
def reference_encode(spark, sf_dir):
    s = sequences(spark, sf_dir)
    reference = (s.orderBy(F.desc(F.length("bases")), "doc_id").first() or [0, ""])[1].encode()
    coded = s.select("doc_id", genome.encode_against(F.col("bases").cast("binary"), reference).alias("segments"))
    matched = F.filter("segments", lambda x: x["op"] == "match")
    return coded.select("doc_id", F.size("segments").alias("n_segments"), F.size(matched).alias("n_matches"))


def small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks_of(payloads(spark, sf_dir), "doc_id", "data", SMALL_CHUNK)


CHUNKS = f"""WITH raw AS (SELECT doc_id AS file, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
chunks AS (SELECT file, i AS chunk_id, i * {SMALL_CHUNK} AS chunk_start, substr(h, 2 * i * {SMALL_CHUNK} + 1, 2 * {SMALL_CHUNK}) AS payload FROM (SELECT file, h, unnest(range(0, (n + {SMALL_CHUNK} - 1) // {SMALL_CHUNK})) AS i FROM raw)) """


@query(CHUNKS + "SELECT file, chunk_id, chunk_start, payload FROM chunks")
def chunk_scan(spark, sf_dir):
    return small_chunks(spark, sf_dir).select("file", "chunk_id", "chunk_start", F.hex("payload").alias("payload"))


@query("SELECT doc_id AS file, substr(hex(encode(text)), 201, 600) AS content FROM documents WHERE octet_length(encode(text)) > 100")
def chunk_range_read(spark, sf_dir):
    return chunks.byte_range(small_chunks(spark, sf_dir), 100, 300).select("file", F.hex("content").alias("content"))


@query(f"SELECT doc_id AS file, (200 // {SMALL_CHUNK})::BIGINT AS chunk_id, (200 % {SMALL_CHUNK})::BIGINT AS within FROM documents WHERE octet_length(encode(text)) > 200")
def offset_to_chunk(spark, sf_dir):
    return chunks.chunk_for(small_chunks(spark, sf_dir), 200)


@query(CHUNKS + f", p AS (SELECT file, chunk_id, CASE WHEN chunk_id = 1 THEN 'ABCD' ELSE payload END AS payload FROM chunks) SELECT file, chunk_id, coalesce(sum(length(payload) // 2) OVER (PARTITION BY file ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_start, payload FROM p")
def chunk_patch(spark, sf_dir):
    own = small_chunks(spark, sf_dir)
    change = own.filter("chunk_id = 1").select("file", "chunk_id", F.unhex(F.lit("ABCD")).alias("payload"))
    return chunks.patched(own, change).select("file", "chunk_id", "chunk_start", F.hex("payload").alias("payload"))


@query("SELECT doc_id AS file, hex(encode(text || ' ' || source)) AS content FROM documents WHERE octet_length(encode(text)) > 0")
def chunk_append(spark, sf_dir):
    more = documents(spark, sf_dir).filter("octet_length(text) > 0").select(F.col("doc_id").alias("file"), F.encode(F.concat(F.lit(" "), "source"), "UTF-8").alias("content"))
    return chunks.joined(chunks.appended(small_chunks(spark, sf_dir), more, SMALL_CHUNK)).select("file", F.hex("content").alias("content"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and a second version that changes, shrinks or extends them."""
    t = F.col("text")
    second = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(t, "ion", "ATE")).when(F.col("doc_id") % 3 == 1, F.expr("left(text, length(text) DIV 2)")).otherwise(F.concat(t, t))
    docs = documents(spark, sf_dir).filter("octet_length(text) > 0")
    return docs.select("doc_id", B.payload(t).alias("data")), docs.select("doc_id", B.payload(second).alias("data"))


SECOND = f"""WITH v AS (SELECT doc_id, hex(encode(text)) AS a, hex(encode(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, 'ion', 'ATE', 'g') WHEN doc_id % 3 = 1 THEN left(text, length(text) // 2) ELSE text || text END)) AS b FROM documents WHERE octet_length(encode(text)) > 0) """


@query(SECOND + f""", c AS (SELECT doc_id, i, substr(a, 2 * i * {SMALL_CHUNK} + 1, 2 * {SMALL_CHUNK}) AS x, substr(b, 2 * i * {SMALL_CHUNK} + 1, 2 * {SMALL_CHUNK}) AS y, length(b) // 2 AS new_size
  FROM (SELECT *, unnest(range(0, (length(b) // 2 + {SMALL_CHUNK} - 1) // {SMALL_CHUNK})) AS i FROM v)),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c WHERE x <> y)
SELECT doc_id AS file, min(i) * {SMALL_CHUNK} AS start, sum(length(x) // 2)::BIGINT AS original_len, string_agg(y, '' ORDER BY i) AS payload, min(new_size) AS new_size FROM k GROUP BY doc_id, island""")
def block_delta(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return chunks.delta(old, new, "doc_id", "data", SMALL_CHUNK).withColumn("payload", F.hex("payload"))


@query(SECOND + "SELECT doc_id AS file, b AS content FROM v")
def apply_delta(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    patches = chunks.delta(old, new, "doc_id", "data", SMALL_CHUNK)
    sizes = new.select(F.col("doc_id").alias("file"), F.octet_length("data").cast("long").alias("new_size"))
    return chunks.apply_delta(old, patches, sizes, "doc_id", "data", SMALL_CHUNK).select("file", F.hex("content").alias("content"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, source/doc_id, as a source may be larger than a row can be."""
    return documents(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_name"), B.payload(F.col("text")).alias("content"))


def chunk_archive(spark: SparkSession, sf_dir: str) -> chunk_store.ChunkArchive:
    return chunk_store.write(payloads(spark, sf_dir), scratch(spark, "chunks"), "doc_id", "data", SMALL_CHUNK)


@query("SELECT doc_id::VARCHAR AS file, hex(encode(coalesce(text, ''))) AS content FROM documents")
def chunk_archive_read(spark, sf_dir):
    return chunk_archive(spark, sf_dir).read().select("file", F.hex("content").alias("content"))


@query("SELECT doc_id::VARCHAR AS file, substr(hex(encode(text)), 201, 600) AS content FROM documents WHERE octet_length(encode(text)) > 100")
def chunk_archive_range(spark, sf_dir):
    return chunk_archive(spark, sf_dir).range(100, 300).select("file", F.hex("content").alias("content"))


@query("SELECT doc_id::VARCHAR AS file, hex(encode(coalesce(text, '') || ' ' || source)) AS content FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, hex(encode(coalesce(text, ''))) FROM documents WHERE source IS NULL")
def chunk_archive_append(spark, sf_dir):
    a = chunk_archive(spark, sf_dir)
    a.append(documents(spark, sf_dir).filter("source IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), F.encode(F.concat(F.lit(" "), "source"), "UTF-8").alias("content")))
    return a.read().select("file", F.hex("content").alias("content"))


@query(CHUNKS + f", p AS (SELECT file, chunk_id, CASE WHEN chunk_id = 1 THEN 'ABCD' ELSE payload END AS payload FROM chunks) SELECT file::VARCHAR AS file, chunk_id, coalesce(sum(length(payload) // 2) OVER (PARTITION BY file ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_start, payload FROM p")
def chunk_archive_patch(spark, sf_dir):
    a = chunk_archive(spark, sf_dir)
    a.patch(a.layout.filter("chunk_id = 1").select("file", "chunk_id", F.unhex(F.lit("ABCD")).alias("payload")))
    return a.chunks.select("file", "chunk_id", "chunk_start", F.hex("payload").alias("payload"))


@query(DETECT.replace("SELECT raw.doc_id, kind, CASE kind", "SELECT raw.doc_id::VARCHAR AS file_name, raw.n AS raw_bytes, md5(unhex(raw.h)) AS content_md5, kind, CASE kind").split(", CASE kind WHEN")[0] + DETECT[DETECT.index("\nFROM raw JOIN"):])
def raw_archive(spark, sf_dir):
    """Payloads under the transform that their bytes name, a dictionary and zstd, opened again."""
    own = payloads(spark, sf_dir).filter("data IS NOT NULL").select(F.col("doc_id").cast("string").alias("file_name"), F.col("data").alias("content"))
    a = raw.write(own, scratch(spark, "raw"))
    return a.read().join(a.rows.select("file_name", "raw_bytes", "kind"), "file_name").select("file_name", "raw_bytes", F.md5("content").alias("content_md5"), "kind")


@query("SELECT concat_ws('/', source, doc_id) AS file_name, octet_length(encode(coalesce(text, '')))::BIGINT AS original_size FROM documents UNION ALL SELECT NULL, sum(octet_length(encode(coalesce(text, ''))))::BIGINT FROM documents")
def multi_file_sizes(spark, sf_dir):
    """The listing of a pack: each file and the total; what SQL can say of it."""
    path = scratch(spark, "pack")
    files.pack(members(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit(b"").cast("binary"))), path)
    return files.listing(spark, path).select("file_name", "original_size")


@query()
def multi_file_list(spark, sf_dir):
    """Sizes and ratios of a pack by source and in total."""
    path = scratch(spark, "pack")
    files.pack(members(spark, sf_dir), path)
    own = files.listing(spark, path).filter("file_name IS NOT NULL")
    source = F.when(F.contains("file_name", F.lit("/")), F.regexp_extract("file_name", "(?s)^(.*)/[^/]*$", 1))
    return files.totals(own.withColumn("file_name", source)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT concat_ws('/', source, doc_id) AS file_name, text FROM documents WHERE text IS NOT NULL")
def multi_file_extract(spark, sf_dir):
    path = scratch(spark, "pack")
    files.pack(members(spark, sf_dir).filter("content IS NOT NULL"), path)
    return files.extract(spark, path).select("file_name", F.decode("content", "UTF-8").alias("text"))


@query()
def zstd_ratio(spark, sf_dir):
    p = payloads(spark, sf_dir).withColumn("size", F.octet_length("data")).withColumn("frame", codec.compressed(F.col("data"), 3))
    ratio = F.when(F.col("size") > 0, F.octet_length("frame") / F.col("size"))
    return p.select("doc_id", "size", F.round(ratio, 6).alias("ratio"), B.would_bloat(F.col("size"), F.octet_length("frame")).alias("stored"))


@query()
def stored_fallback(spark, sf_dir):
    p = payloads(spark, sf_dir).withColumn("size", F.octet_length("data")).withColumn("frame", codec.compressed(F.col("data"), 3))
    return p.select("doc_id", B.would_bloat(F.col("size"), F.octet_length("frame")).alias("stored"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
