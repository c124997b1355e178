"""Vectors: norms, projections, quantised sketches and similarity search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """The vector at length one; one of next to no length stays as it is."""
    n = norm(v)
    return F.when(n > TINY, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one has next to no length."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def scores(vectors: DataFrame, query, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """(id, score) against one query; a query without length scores nothing."""
    if not len(query) or sum(float(x) ** 2 for x in query) ** 0.5 < TINY:
        return vectors.select(id_column, F.lit(0.0).alias("score")).filter(F.lit(False))
    return vectors.select(id_column, cosine(doubles(F.col(vector_column)), literal(query)).alias("score"))


def above(vectors: DataFrame, query, threshold: float, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """All vectors with a score of the threshold or more, best first, ties by id."""
    return scores(vectors, query, id_column, vector_column).filter(F.col("score") >= threshold).orderBy(F.desc("score"), id_column)


def top(vectors: DataFrame, query, k: int, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """The k best; each task keeps k."""
    return scores(vectors, query, id_column, vector_column).orderBy(F.desc("score"), id_column).limit(k)


def merged(vectors: DataFrame, by: str, vector_column: str = "embedding") -> DataFrame:
    """The element-wise sum of each group's vectors, from partial sums."""
    each = vectors.select(by, F.posexplode(doubles(F.col(vector_column))).alias("i", "x"))
    return each.groupBy(by, "i").agg(F.sum("x").alias("x"))


def empty(dim: int) -> Column:
    """The sketch of nothing."""
    return F.array_repeat(F.lit(0.0), dim)


@cache
def signs(rows: int, columns: int, seed: int = 7) -> np.ndarray:
    """A matrix of random signs, the same on every worker."""
    return np.random.default_rng((seed, rows, columns)).choice(np.array([-1.0, 1.0]), (rows, columns))


def checked_dim(dim: int) -> int:
    if dim < 16 or dim > 256 or dim & (dim - 1):
        raise ValueError(f"{dim} isn't a power of two from 16 to 256")
    return dim


def project_array(v: np.ndarray, dim: int) -> np.ndarray:
    """Rows projected to dim by random signs over sqrt(dim); rows of that length stay."""
    return v if v.shape[1] == dim else v @ signs(v.shape[1], dim) / np.sqrt(dim)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows; lists that differ, or null ones, are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (column.null_count or len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any()):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def project(vectors: DataFrame, dim: int, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """(id, projected): Johnson-Lindenstrauss projections of vectors of one length."""
    checked_dim(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(project_array(_matrix(b.column(1)), dim), pa.float64())], [id_column, "projected"])

    rows = vectors.select(id_column, doubles(F.col(vector_column)).alias("v"))
    return rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, projected array<double>")


def project_sparse(terms: DataFrame, dim: int, id_column: str, terms_total: int) -> DataFrame:
    """(id, projected) of (id, term_id, weight): each term adds its weighted row of signs, partial sums first."""
    checked_dim(dim)
    table = signs(terms_total, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, weight = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            part = table[at] * weight[:, None] / np.sqrt(dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(at)), dim))), pa.array(np.tile(np.arange(dim), len(at)), pa.int32()), pa.array(part.ravel())], [id_column, "i", "x"])

    rows = terms.select(id_column, "term_id", F.col("weight").cast("double"))
    each = rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, i int, x double").groupBy(id_column, "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select(id_column, F.transform("v", lambda e: e["x"]).alias("projected"))


@cache
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """Random signs, then Walsh-Hadamard: an orthogonal matrix that evens out the coordinates."""
    h = np.ones((1, 1))
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return np.random.default_rng((seed, dim)).choice(np.array([-1.0, 1.0]), dim)[:, None] * h / np.sqrt(dim)


def quantize_array(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(norms, codes): normalised, rotated, times sqrt(d), on a uniform grid of 2^bits steps from -3 to 3."""
    if bits not in (2, 4):
        raise ValueError("2 or 4 bits")
    norms = np.linalg.norm(v, axis=1)
    unit = v / np.where(norms > TINY, norms, 1)[:, None]
    steps = 1 << bits
    z = unit @ rotation(v.shape[1]) * np.sqrt(v.shape[1])
    return norms, np.clip(np.floor((z + 3) / (6 / steps)), 0, steps - 1).astype(np.int8)


def centroids(codes: np.ndarray, bits: int) -> np.ndarray:
    return -3 + 6 / (1 << bits) * (codes + 0.5)


def dequantize_array(norms: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    d = codes.shape[1]
    return centroids(codes, bits) / np.sqrt(d) @ rotation(d).T * norms[:, None]


def pack(codes: np.ndarray, bits: int) -> list[bytes]:
    """Codes of each row, 8 / bits to a byte."""
    per = 8 // bits
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % per)))
    parts = codes.astype(np.uint8).reshape(len(codes), -1, per)
    return [row.tobytes() for row in np.bitwise_or.reduce(parts << (bits * np.arange(per, dtype=np.uint8)), axis=2)]


def unpack(packed: list[bytes], bits: int) -> np.ndarray:
    per = 8 // bits
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return (raw[:, :, None] >> (bits * np.arange(per, dtype=np.uint8)) & ((1 << bits) - 1)).reshape(len(packed), -1).astype(np.int8)


def quantize(vectors: DataFrame, bits: int, id_column: str, vector_column: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, norm, codes, packed, dim, bits): sketches of vectors, projected to dim if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                v = project_array(v, dim) if dim else v
                norms, codes = quantize_array(v, bits)
                n = len(v)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norms), _lists(codes, pa.int8()), pa.array(pack(codes, bits), pa.binary()), pa.array([v.shape[1]] * n, pa.int32()), pa.array([bits] * n, pa.int32())], [id_column, "norm", "codes", "packed", "dim", "bits"])

    rows = vectors.select(id_column, doubles(F.col(vector_column)).alias("v"))
    return rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, norm double, codes array<tinyint>, packed binary, dim int, bits int")


def quantized_cosine(a: Column, b: Column, bits: int) -> Column:
    """Cosine of the grid's centroids, from the codes alone."""
    at = lambda c: F.transform(c, lambda i: -3 + 6.0 / (1 << bits) * (i + 0.5))
    return cosine(at(a), at(b))


def quantized_inner_product(norm_a: Column, a: Column, norm_b: Column, b: Column, bits: int) -> Column:
    at = lambda c: F.transform(c, lambda i: -3 + 6.0 / (1 << bits) * (i + 0.5))
    return dot(at(a), at(b)) / F.size(a) * norm_a * norm_b


def quantized_top(sketches: DataFrame, query, k: int, id_column: str, bits: int = 4) -> DataFrame:
    """The k best by quantised cosine; the query is quantised once, on the driver."""
    v = np.asarray(query, np.float64)[None, :]
    if not v.size or np.linalg.norm(v) < TINY:
        return sketches.select(id_column, F.lit(0.0).alias("score")).filter(F.lit(False))
    _, codes = quantize_array(v, bits)
    asked = F.array(*[F.lit(int(c)) for c in codes[0]])
    return sketches.select(id_column, quantized_cosine(F.col("codes"), asked, bits).alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def similar_sketches(sketches: DataFrame, query, threshold: float | None, k: int | None, id_column: str) -> DataFrame:
    """(id, score) of packed sketches (id, norm, packed, dim, bits) against a vector, best first.

    The query is projected and quantised once for each (dim, bits) that a batch has; codes are
    unpacked a batch at a time.
    """
    v = np.asarray(query, np.float64)[None, :]
    none = not v.size or np.linalg.norm(v) < TINY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, bits = b.column(3).to_numpy(), b.column(4).to_numpy()
            score, norm = np.zeros(b.num_rows), b.column(1).to_numpy()
            packed = b.column(2).to_pylist()
            for d, w in sorted(set(zip(dim.tolist(), bits.tolist(), strict=True))):
                own = np.flatnonzero((dim == d) & (bits == w))
                mine = centroids(quantize_array(project_array(v, d), w)[1], w)[0]
                theirs = centroids(unpack([packed[i] for i in own], w)[:, :d], w)
                score[own] = np.clip(theirs @ mine / np.linalg.norm(theirs, axis=1) / np.linalg.norm(mine), -1, 1)
            score[norm <= TINY] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [id_column, "score"])

    rows = sketches.select(id_column, "norm", "packed", "dim", "bits")
    out = rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, score double")
    out = out.filter(F.lit(not none))
    out = out if threshold is None else out.filter(F.col("score") >= threshold)
    out = out.orderBy(F.desc("score"), id_column)
    return out if k is None else out.limit(k)


class SimilarityIndex:
    """Sketches held in the executors' memory, added to and asked again and again."""

    def __init__(self, spark, bits: int = 4, dim: int | None = None):
        self.spark, self.bits, self.dim, self.own = spark, bits, dim, None

    def add(self, vectors: DataFrame, id_column: str = "block_id", vector_column: str = "embedding") -> SimilarityIndex:
        new = quantize(vectors.withColumnRenamed(id_column, "block_id"), self.bits, "block_id", vector_column, self.dim).drop("codes").persist()
        self.own = new if self.own is None else self.own.unionByName(new)
        return self

    def query(self, query, threshold: float) -> DataFrame:
        return self._asked(query, threshold, None)

    def query_top(self, query, k: int) -> DataFrame:
        return self._asked(query, None, k)

    def _asked(self, query, threshold: float | None, k: int | None) -> DataFrame:
        if self.own is None:
            return self.spark.createDataFrame([], "block_id long, score double")
        return similar_sketches(self.own, query, threshold, k, "block_id")

    def count(self) -> int:
        return 0 if self.own is None else self.own.count()


def with_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(block_id, score, lines) of similar blocks."""
    texts = lines.join(found.select("block_id"), "block_id", "left_semi").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return found.join(texts, "block_id").select("block_id", "score", F.transform("ls", lambda x: x["line"]).alias("lines"))
