"""Substring dedup with repeated-phrase automata.

1. Confirm: documents are dealt to parts by their ids, and every run of n words (a window) is
   hashed. A part reports each window once, with the smallest of its doc_ids that has it, packed
   by ranges of the hash; a range learns who owns a window, the smallest doc_id of all, and which
   parts ask for it: those where another document has it.
2. Passages: in the owner's text, consecutive windows that a part asks for join into the passages
   of that part. Hashes only nominate; from here on words are compared.
3. Compile: a part's passages are cut into phrases of (n + 1) / 2 words side by side, one of which
   lies in every window, and compiled into an Aho-Corasick automaton.
4. Stream: every document of the part that holds a window of a smaller one runs through the
   automaton. Hits on one diagonal of a passage chain into a match, which is extended word by word
   at its two ends; a match of n words or more of a passage of a smaller doc_id is removed.

A passage that a third of all documents share is reported, asked for and compiled once a part.
What a part gets are windows that its own documents hold, so that an automaton doesn't grow with
the number of parts. Documents that hold no window of a smaller one never run through one.

Defined results: a null or empty text has no words; rows without doc_id are kept whole and
own nothing; rows of one doc_id don't remove each other's words; a text shorter than n words
keeps all of them; other columns pass through, whatever their names are: an own column whose
name is taken gets an underscore behind it (``free_names``).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import partitions_for, stored
from .words import CHUNK_BYTES, WordHashes, chunks, free_names, mix, only_ids, pack_longs, pack_sorted, range_of, unpack_longs, unpack_sorted, windows, word_arrays

SLICE_BYTES, PART_BYTES = 24 << 20, 16 << 20
OWN_TYPES = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept", T.StringType()),
])
OWN = OWN_TYPES.names


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal neighbours begins."""
    return np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of equal neighbours."""
    cut = _groups(keys).tolist()
    return zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``CHUNK_BYTES`` of binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > CHUNK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _dealt(ids: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of ids that are dealt over parts by their hash."""
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    yield from ((int(part[order[b]]), order[b:e]) for b, e in _slices(part[order]))


REPORT = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("first", pa.binary()), ("several", pa.binary()), ("later", pa.binary())])
PASSAGE = pa.schema([("part", pa.int32()), ("owner", pa.int64()), ("passage", pa.binary())])


def _report(part: int, ids: np.ndarray, hashes: np.ndarray, lens: np.ndarray, n: int, shards: int) -> Iterator[tuple]:
    """The rows of ``reports`` for documents of one part."""
    at, h = windows(hashes, lens, n)
    if not len(at):
        return
    doc = np.repeat(ids, lens)[at]
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    begin = _groups(h)
    first = np.minimum.reduceat(doc, begin)
    several = np.maximum.reduceat(doc, begin) != first
    later = np.unique(doc[doc != np.repeat(first, np.diff(begin, append=len(h)))]).tobytes()
    h = h[begin]
    shard = range_of(h, shards)
    cuts = list(_slices(shard))
    for k, (b, e) in enumerate(cuts):
        yield int(shard[b]), part, pack_sorted(h[b:e]), pack_longs(first[b:e].view(np.uint64)), np.packbits(several[b:e]).tobytes(), later if k == part % len(cuts) else b""


def reports(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """What each part of the documents, whose rows lie together, reports to each range of hashes.

    hashes: the windows of the part; first: the smallest doc_id with each; several: it has
    another one in the part; later: documents that share a window with a smaller one of the
    part. A part of over ``SLICE_BYTES`` reports by slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            known, part, held, size = WordHashes(), None, [], 0
            for batch, texts in chunks(batches):
                ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "part"))
                for b, e in _slices(parts):
                    if held and (parts[b] != part or size > SLICE_BYTES):
                        yield from _report(part, *map(np.concatenate, zip(*held, strict=True)), n, shards)
                        held, size = [], 0
                    part = int(parts[b])
                    held.append((ids[b:e], *word_arrays(texts[b:e], known)))
                    size += sum(map(len, texts[b:e]))
            if held:
                yield from _report(part, *map(np.concatenate, zip(*held, strict=True)), n, shards)

        yield from _batches(rows(), REPORT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "part")
    return rows.mapInArrow(run, "shard int, part int, hashes binary, first binary, several binary, later binary")


def _confirm(table: pa.Table, bins: int) -> pa.Table:
    """What one range has found, dealt over bins by document: who owns windows and which parts ask for them, and who holds a smaller one's.

    A window is named by the lower half of its hash, which is enough inside the owner's text: one
    too many only makes a passage longer.
    """
    hashes, firsts, several, parts, later = [], [], [], [], []
    for _, part, h, first, many, behind in zip(*(c.to_pylist() for c in table.columns), strict=True):
        hashes.append(unpack_sorted(h))
        firsts.append(unpack_longs(first).view(np.int64))
        several.append(np.unpackbits(np.frombuffer(many, np.uint8), count=len(hashes[-1])).astype(bool))
        parts.append(np.full(len(hashes[-1]), part, np.int32))
        later.append(np.frombuffer(behind, np.int64))
    h, doc, many, part = map(np.concatenate, (hashes, firsts, several, parts))
    order = np.argsort(h)
    h, doc, many, part = h[order], doc[order], many[order], part[order]
    begin = _groups(h)
    owner = np.repeat(np.minimum.reduceat(doc, begin), np.diff(begin, append=len(h)))
    holds = np.unique(np.concatenate([*later, doc[doc != owner]]))
    asks = many | (doc != owner)
    own, what, part = owner[asks], h[asks].astype(np.uint32), part[asks]
    rows = [(b, own[at].tobytes(), what[at].tobytes(), part[at].tobytes(), b"") for b, at in _dealt(own, bins)]
    rows += [(b, b"", b"", b"", holds[at].tobytes()) for b, at in _dealt(holds, bins)]
    return pa.table([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(5)], ["bin", "owners", "windows", "parts", "holds"])


def _gather(table: pa.Table) -> pa.Table:
    """Of one bin of the documents: (doc, windows, parts) of owners, (doc, null, null) of those that hold a smaller one's, each once."""
    own, what, part, holds = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("owners", np.int64), ("windows", np.uint32), ("parts", np.int32), ("holds", np.int64)))
    order = np.lexsort((part, own))
    own, what, part = own[order], what[order], part[order]
    cuts, holds = list(_slices(own)), np.unique(holds)
    return pa.table({
        "doc": pa.array(np.concatenate((own[_groups(own)], holds)), pa.int64()),
        "windows": pa.array([*(what[b:e].tobytes() for b, e in cuts), *[None] * len(holds)], pa.binary()),
        "parts": pa.array([*(part[b:e].tobytes() for b, e in cuts), *[None] * len(holds)], pa.binary()),
    })


def confirm(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """(doc, windows, parts): the owners' recurring windows with the parts that ask for them; (doc, null, null): documents that hold one of a smaller one."""
    dealt = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", "part").repartitionById(parts, "part")
    found = reports(dealt, n, 2 * parts).groupBy("shard").applyInArrow(lambda t: _confirm(t, parts), "bin int, owners binary, windows binary, parts binary, holds binary")
    return found.groupBy("bin").applyInArrow(_gather, "doc long, windows binary, parts binary")


def passages(docs: DataFrame, confirmed: DataFrame, n: int) -> DataFrame:
    """(part, owner, passage): the owners' runs of windows that a part asks for, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            known = WordHashes()
            for batch, texts in chunks(batches):
                for doc, text, mine, parts in zip(batch.column("doc_id").to_pylist(), texts, batch.column("windows").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                    words = text.split()
                    at, h = windows(known.of(words), np.array([len(words)]), n)
                    if not len(at):
                        continue
                    have, first = np.unique(h.astype(np.uint32), return_index=True)
                    asked, part = np.frombuffer(mine, np.uint32), np.frombuffer(parts, np.int32)
                    place = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                    mask = have[place] == asked  # else of another row of this doc_id
                    # by part and place; a part's next place is one further
                    where = np.unique(part[mask].astype(np.int64) << 32 | at[first[place[mask]]])
                    cut = np.nonzero(np.diff(where, prepend=-2) != 1)[0]
                    for b, e in zip((where[cut]).tolist(), where[[*(cut[1:] - 1), len(where) - 1]].tolist() if len(where) else [], strict=True):
                        yield b >> 32, doc, b" ".join(words[b & 0xFFFFFFFF : (e & 0xFFFFFFFF) + n])

        yield from _batches(rows(), PASSAGE)

    own = confirmed.filter("windows IS NOT NULL").select(F.col("doc").alias("doc_id"), "windows", "parts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return only_ids(rows, own).join(own, "doc_id").select("doc_id", "text", "windows", "parts").mapInArrow(run, "part int, owner long, passage binary")


def demand(confirmed: DataFrame) -> DataFrame:
    """(doc_id, owner): whose passages each document may hold, by ties; ``dedup`` has parts ask by windows instead.

    A tie of a slice is followed by the ties to owners only, never by another of its kind: a
    document is the smallest of its own slice for no more documents than a slice has.
    """
    pairs = confirmed.filter("before IS NOT NULL")
    inside = pairs.filter("tie = 0").select(F.col("doc").alias("doc_id"), F.col("before").alias("via"))
    across = pairs.filter("tie = 1").select(F.col("doc").alias("via"), F.col("before").alias("owner")).distinct()
    further = inside.distinct().join(across, "via").select("doc_id", "owner")
    direct = pairs.select(F.col("doc").alias("doc_id"), F.col("before").alias("owner"))
    return direct.unionByName(further).distinct()


class Automaton:
    """Finds what texts have of passages, n words or more.

    Words of the passages are numbered and written with ``width`` characters each, so that the
    automaton has a few short steps a word; a hit between words is no hit.
    """

    DIGITS = "".join(map(chr, range(0x30, 0x30 + 64)))
    OTHER = "!"

    def __init__(self, owners: list[int], texts: list[bytes], n: int):
        self.n, self.block = n, (n + 1) // 2
        self.owners, self.words = owners, [t.split() for t in texts]
        distinct = dict.fromkeys(w for words in self.words for w in words)
        self.width = next(k for k in range(1, 99) if 64**k >= len(distinct))
        self.code = {w: self._digits(i) for i, w in enumerate(distinct)}
        self.other = self.OTHER * self.width
        self.places: list[list[tuple[int, int]]] = []
        self.trie, index, size = ahocorasick.Automaton(), {}, self.block * self.width
        for q, words in enumerate(self.words):
            text = "".join(map(self.code.__getitem__, words))
            for j in range(0, len(words) - self.block + 1, self.block):
                phrase = text[j * self.width : j * self.width + size]
                if phrase not in index:
                    index[phrase] = len(self.places)
                    self.places.append([])
                    self.trie.add_word(phrase, index[phrase])
                self.places[index[phrase]].append((q, j))
        if self.places:
            self.trie.make_automaton()

    def _digits(self, i: int) -> str:
        return "".join(self.DIGITS[i >> 6 * k & 63] for k in range(self.width))

    def matches(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of the word runs that belong to passages of a smaller doc_id, apart and in order."""
        if not self.places or len(words) < self.n:
            return []
        get, other, width, side = self.code.get, self.other, self.width, self.n - self.block
        until: dict[tuple[int, int], int] = {}  # how far each diagonal is known
        first = last = 0  # the run that reaches furthest
        runs = []
        for end, phrase in self.trie.iter("".join([get(w, other) for w in words])):
            if (end + 1) % width:
                continue
            at = (end + 1) // width - self.block
            # windows with this phrase lie here; further ones have another phrase of their passage
            if first <= max(at - side, 0) and min(at + self.n, len(words)) <= last:
                continue
            for q, j in self.places[phrase]:
                passage, shift = self.words[q], at - j
                if self.owners[q] >= doc_id:
                    continue
                if len(passage) == self.n:  # a single window
                    if shift < 0 or words[shift : shift + self.n] != passage:
                        continue
                    run = (shift, shift + self.n)
                elif until.get((q, shift), -1) <= at:
                    run = self._extended(words, passage, at, shift)
                    until[q, shift] = run[1]
                    if run[1] - run[0] < self.n:
                        continue
                else:
                    continue
                runs.append(run)
                if run[1] > last:
                    first, last = run
        runs.sort()
        out: list[tuple[int, int]] = []
        for start, end in runs:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out

    def _extended(self, words: list[bytes], passage: list[bytes], at: int, shift: int) -> tuple[int, int]:
        """The longest equal run around words at .. at + block, on the diagonal; steps of 64 words first."""
        start, end = at, at + self.block
        while start > max(shift, 0) and words[start - 1] == passage[start - shift - 1]:
            start -= 1
        last = min(len(words), len(passage) + shift)
        while end + 64 <= last and words[end : end + 64] == passage[end - shift : end - shift + 64]:
            end += 64
        while end < last and words[end] == passage[end - shift]:
            end += 1
        return start, end


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return b" ".join(words)
    edges = [0, *(x for span in spans for x in span), len(words)]
    return b" ".join([w for b, e in zip(edges[::2], edges[1::2], strict=True) for w in words[b:e]])


def _rows(batch: pa.RecordBatch, columns: list[str], split: list[list[bytes]], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    kept = pa.array([_kept(w, s) for w, s in zip(split, spans, strict=True)], pa.binary()).cast(pa.string())
    removed = pa.array([[{"start": b, "end": e} for b, e in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(list(map(len, split)), pa.int64()), removed, kept], [*columns, *OWN])


def dedup(docs: DataFrame, n: int = 13) -> DataFrame:
    """All columns of docs, then n_words, removed (spans of word numbers) and kept (the other words, joined by one space)."""
    given, schema_in = docs.columns, docs.schema
    # inside, the other columns have names that no own one has
    inner = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(given)}
    columns = [inner[c] for c in given]
    docs = docs.select(*(F.col(f"`{c}`").alias(inner[c]) for c in given)).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    parts = partitions_for(docs, PART_BYTES)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    confirmed = stored(confirm(docs.withColumn("part", part), n, parts), "confirmed")
    affected = confirmed.filter("windows IS NULL").select(F.col("doc").alias("doc_id"))
    needed = passages(docs, confirmed, n)
    schema = T.StructType([*docs.schema.fields, *OWN_TYPES])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, owners, texts, automaton = None, [], [], None
        for batch, own in chunks(batches):
            parts, doc_ids = batch.column("part").to_pylist(), batch.column("doc_id").to_pylist()
            keep, split, spans = [], [], []
            for i, (p, owner, passage) in enumerate(zip(parts, batch.column("owner").to_pylist(), batch.column("passage").to_pylist(), strict=True)):
                if p != part:
                    part, owners, texts, automaton = p, [], [], None
                if owner is not None:
                    owners.append(owner)
                    texts.append(passage)
                    continue
                automaton = automaton or Automaton(owners, texts, n)
                keep.append(i)
                split.append(own[i].split())
                spans.append(automaton.matches(doc_ids[i], split[-1]))
            if keep:
                yield _rows(batch.take(pa.array(keep)), columns, split, spans)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks(batches):
            split = [t.split() for t in own]
            yield _rows(batch, columns, split, [[] for _ in split])

    both = only_ids(docs, affected).select(*columns).withColumn("part", part).unionByName(needed, allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("owner").isNull())
    clean = only_ids(docs, affected, how="left_anti").select(*columns)
    out = dealt.mapInArrow(stream, schema).unionByName(clean.mapInArrow(plain, schema))
    back = [F.col(inner[f.name]).cast(f.dataType).alias(f.name) for f in schema_in]
    return out.select(*back, *(F.col(c).alias(name) for c, name in zip(OWN, free_names(given, OWN), strict=True)))
