"""MinHash near-deduplication with odd sketches.

1. Each document becomes its set of distinct word shingles, 128 MinHash samples of it, 32 band
   keys of 4 samples each, and two odd sketches: the samples folded into 512 parity bits, and
   the whole set folded into 1,024.
2. Documents with equal sets form a class; one representative of each goes on.
3. Classes that share a band key are candidates. First, each class meets one hub of its
   buckets, so that a bucket of copies of one text costs a row each, not a row a pair. Then
   the buckets that still span several components are closed: their members' sketches are
   compared in blocks of ``BLOCK``, and each member names the nearest of other components,
   more of them in each turn, until every pair that the sketches can't exclude was named.
4. Sketches exclude a pair whose samples differ in more bits than a pair of the asked
   similarity could show by chance (``max_odd``), and a pair whose sets certainly differ in
   more shingles than the similarity allows: the XOR's population count is never above their
   symmetric difference. The rest is confirmed on the full sets.
5. Links become components by stars (graph.py).

Two texts at the threshold share no band with probability (1 - 0.85^4)^32 < 1e-10; all links
that share one are found.

Defined results: a document without words (null, empty, white space) has an empty set and is
its own component; one with fewer words than a shingle has its whole sequence as one shingle;
rows without doc_id take part in no link, their component is null and they are kept; rows that
repeat a doc_id count as that document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graph import components
from .words import WordHashes, chunks, free_names, mix, only_ids, starts, windows, word_arrays

SAMPLES, ROWS, BITS, SET_BITS = 128, 4, 512, 1024
BLOCK, NAMED = 1024, 2
#: Members of buckets, 250 bytes each, for a task.
TASK_ROWS = 500_000
BANDS = SAMPLES // ROWS


def max_odd(samples: int, percent: int, miss: float = 1e-9) -> int:
    """Most differing sketch bits of a pair at the similarity, but for a chance of ``miss``.

    A sample differs with probability 1 - J and then toggles at most two bits.
    """
    p, tail, m = 1 - percent / 100, 0.0, samples
    while m and tail + (chance := comb(samples, m) * p**m * (1 - p) ** (samples - m)) < miss:
        tail += chance
        m -= 1
    return 2 * m


def shingle_sets(texts: list[bytes], known: WordHashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and their numbers."""
    hashes, lens = word_arrays([t.lower() for t in texts], known)
    at, h = windows(hashes, lens, n)
    doc = np.repeat(np.arange(len(lens)), lens)
    few, begin = np.nonzero((lens > 0) & (lens < n))[0], starts(lens)
    own = [int.from_bytes(xxhash.xxh3_64_digest(hashes[begin[d] : begin[d] + lens[d]].tobytes() + b"whole")) for d in few]
    doc, h = np.concatenate((doc[at], few)), np.concatenate((h, np.array(own, np.uint64)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[first], np.bincount(doc[first], minlength=len(lens))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, SAMPLES + 1, dtype=np.uint64)
    return mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(k * np.uint64(0xD1B54A32D192ED03))


def minhashes(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SAMPLES minima for each of the non-empty sets that begin there."""
    return np.stack([np.minimum.reduceat((sets ^ b) * a, begin) for a, b in zip(*_permutations(), strict=True)], axis=1)


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS])
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Each sample, with its number, toggles one of BITS parity bits; 64 bits to a long."""
    bit = (mix(mins + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)).astype(np.int64)
    toggles = np.bincount((np.arange(len(mins))[:, None] * BITS + bit).ravel(), minlength=len(mins) * BITS)
    return np.packbits((toggles & 1).astype(np.uint8).reshape(len(mins), BITS), axis=1).view(np.int64)


def parity_sketches(sets: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each shingle toggles one of SET_BITS parity bits of its set."""
    rows = np.repeat(np.arange(len(lens)), lens)
    toggles = np.bincount(rows * SET_BITS + (mix(sets) % np.uint64(SET_BITS)).astype(np.int64), minlength=len(lens) * SET_BITS)
    return np.packbits((toggles & 1).astype(np.uint8).reshape(len(lens), SET_BITS), axis=1).view(np.int64)


def _lists(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    """One list of longs for each True of filled and null for the others."""
    offsets = np.concatenate(([0], np.cumsum(filled * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~filled))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and the two sketches of every row; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in chunks(batches):
            sets, lens = shingle_sets(texts, known, n)
            filled = lens > 0
            begin = starts(lens)
            keys = [xxhash.xxh3_128_digest(sets[b : b + k].tobytes()) if k else None for b, k in zip(begin, lens, strict=True)]
            mins = minhashes(sets, begin[filled]) if len(sets) else np.zeros((0, SAMPLES), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lens, pa.int64()), pa.array(keys, pa.binary()), _lists(band_keys(mins), filled), _lists(odd_sketches(mins), filled), _lists(parity_sketches(sets, lens[filled]), filled)], ["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, parity array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, set) of the nodes (node, rep, set_key), made again from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in chunks(batches):
            sets, lens = shingle_sets(texts, known, n)
            each = [sets[b : b + k].tobytes() for b, k in zip(starts(lens), lens, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in each], pa.binary()), pa.array(each, pa.binary())], ["rep", "set_key", "set"])

    reps = nodes.select(F.col("rep").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = only_ids(rows, reps).select("doc_id", "text").mapInArrow(run, "rep long, set_key binary, set binary")
    return made.join(nodes.select("node", "rep", "set_key"), ["rep", "set_key"]).groupBy("node").agg(F.first("set").alias("set"))


def odd_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def excluded(sketch, parity, size, percent: int):
    """What the sketches exclude, for columns and arrays: bits that differ, and the sum of the sizes of both sets."""
    return (sketch > max_odd(SAMPLES, percent)) | ((100 + percent) * parity > (100 - percent) * size)


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union|: sketches first, then full sets."""
    side = lambda df, k, *vs: df.select(F.col("node").alias(k), *(F.col(v).alias(f"{v}_{k}") for v in vs))
    c, own = F.col, ("sketch", "parity", "n_shingles")
    near = pairs.join(side(nodes, "a", *own), "a").join(side(nodes, "b", *own), "b")
    near = near.filter(~excluded(odd_bits(c("sketch_a"), c("sketch_b")), odd_bits(c("parity_a"), c("parity_b")), c("n_shingles_a") + c("n_shingles_b"), percent)).select("a", "b")
    both = near.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def classes_of(found: DataFrame) -> DataFrame:
    """One row for each distinct set, with its smallest doc_id as rep and a number as node."""
    rows = found.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    return rows.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n_shingles")).withColumn("node", F.monotonically_increasing_id())


def opened(met: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, i, j, block, node, comp) of the buckets that span several components.

    A bucket is cut into blocks by a hash of its members; each two blocks, and each block with
    itself, are one piece of work.
    """
    state = met.select("key", "node").join(comps, "node")
    several = state.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y")
    cut = several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = state.join(cut, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")


def _nearest(group: dict[str, np.ndarray], percent: int, named: int) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """For each member of a piece, the ``named`` nearest of other components that the sketches don't exclude; whether there are more."""
    left = np.flatnonzero(group["block"] == group["i"][0])
    right = np.flatnonzero(group["block"] == group["j"][0])
    comp, size, sketch, parity = (group[k] for k in ("comp", "n_shingles", "sketch", "parity"))
    out_a, out_b, more = [], [], False
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        z, y = (np.bitwise_count(x[rows, None] ^ x[None, right]).sum(axis=2, dtype=np.int32) for x in (sketch, parity))
        open_ = ~excluded(z, y, size[rows, None] + size[None, right], percent) & (comp[rows, None] != comp[None, right])
        n = open_.sum(axis=1)
        more |= bool((n > named).any())
        for k in np.flatnonzero(n):
            far = np.flatnonzero(open_[k])
            if len(far) > named:
                far = far[np.argsort(y[k, far], kind="stable")[:named]]
            out_a.append(np.full(len(far), group["node"][rows[k]]))
            out_b.append(group["node"][right[far]])
    return out_a, out_b, more


def _once(a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs, smaller node first; further ones if any naming says so."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((~more, b, a))
    a, b, more = a[order], b[order], more[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(more[new])], ["a", "b", "more"])


def named_pairs(members: DataFrame, percent: int, named: int, tasks: int) -> DataFrame:
    """(a, b, more): the candidates that the pieces of opened buckets name; more: a member has further ones."""

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        flat = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "block", "node", "comp", "n_shingles")}
        return flat | {k: batch.column(k).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for k in ("sketch", "parity")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[dict[str, np.ndarray]] = []
        for own in _and_end(map(read, (b for b in batches if b.num_rows))):
            if own is not None:
                rest.append(own)
            if not rest:
                continue
            if own is not None and all((own[k][-1] == rest[0][k][0]) for k in ("key", "i", "j")):
                continue  # one piece so far
            now = {k: np.concatenate([r[k] for r in rest]) for k in rest[0]}
            change = np.zeros(len(now["key"]), bool)
            change[0] = True
            for k in ("key", "i", "j"):
                change[1:] |= now[k][1:] != now[k][:-1]
            cut = np.flatnonzero(change)
            whole = cut if own is None else cut[:-1]
            a, b, more = [], [], []
            for n, at in enumerate(whole):
                end = cut[n + 1] if n + 1 < len(cut) else len(change)
                x, y, further = _nearest({k: v[at:end] for k, v in now.items()}, percent, named)
                a, b = a + x, b + y
                more += [np.full(len(v), further) for v in x]
            rest = [] if own is None else [{k: v[cut[-1] :] for k, v in now.items()}]
            if a:
                yield _once(np.concatenate(a), np.concatenate(b), np.concatenate(more))

    return members.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, more boolean")


def _and_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def linked(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, comp) of the classes that share a band with another one."""
    buckets = classes.select("node", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    met = stored(buckets.join(several, "key"), "buckets")
    nodes = stored(met.select("node").distinct().join(classes.drop("bands"), "node"), "nodes")
    sets = stored(full_sets(docs, nodes, n), "sets")
    pairs = met.filter("node <> hub").groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    comps = joined(nodes.select("node", F.col("node").alias("comp")), confirmed(pairs, nodes, sets, percent))
    tested, named = pairs, NAMED
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // TASK_ROWS))
    while True:
        members = opened(met, comps).join(nodes.select("node", "n_shingles", "sketch", "parity"), "node")
        found = stored(named_pairs(members, percent, named, tasks).groupBy("a", "b").agg(F.max("more").alias("more")), "named")
        pairs = stored(found.select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        further = found.filter("more").limit(1).count()
        comps = joined(comps, confirmed(pairs, nodes, sets, percent))
        if not further:
            return comps
        tested, named = tested.unionByName(pairs), 8 * named


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the links have joined components."""
    of = lambda k: comps.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return stored(comps.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    found = stored(signatures(docs, n), "signatures")
    classes = stored(classes_of(found), "classes")
    comps = linked(docs, classes, n, percent)
    least = comps.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    moved = comps.join(least, "comp").select("node", "least")
    names = classes.select("node", "set_key", "rep").join(moved, "node", "left").select("set_key", F.coalesce("least", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = found.select("doc_id", "n_shingles", "set_key").join(names, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unlike_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is missing or names several rows."""
    n = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    return n.filter("doc_id IS NULL OR count > 1").limit(1).count() > 0


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: one row of each component stays.

    Where every row has a doc_id of its own, that is the row of the smallest one. Where ids are
    missing or repeat, rows are judged by their own sets under numbers of their own, for which
    docs are written once more: of a component the row of the smallest doc_id stays, any row
    without one after those with one; of rows without words, one of each doc_id stays, and
    each that has none.
    """
    if not _unlike_ids(docs):
        verdict = stored(near_duplicates(docs, n, percent).select("doc_id", "kept"), "verdict")
        gone = verdict.filter("NOT kept").select("doc_id")
        return only_ids(docs.withColumn("doc_id", F.col("doc_id").cast("long")), gone, how="left_anti").select(*docs.columns)
    (row,) = free_names(docs.columns, ["row"])
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), n, percent)
    own = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    judged = found.withColumnRenamed("doc_id", "row").join(own, "row")
    wordless, unnamed = F.col("n_shingles") == 0, F.col("id").isNull()
    group = F.when(wordless, F.coalesce("id", "row")).otherwise(F.col("component_id"))
    first = F.min(F.struct(unnamed.alias("unnamed"), "id", "row"))
    kept = judged.groupBy(wordless.alias("w"), (wordless & unnamed).alias("u"), group.alias("g")).agg(first.alias("first")).select(F.col("first.row").alias(row))
    return only_ids(numbered, stored(kept, "kept"), row).select(*docs.columns)
