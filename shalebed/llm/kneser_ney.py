"""LM scoring: an interpolated modified Kneser-Ney trigram model.

Spark counts; the model is a folder of sorted hash arrays in the shared folder, which workers
map into memory (``Table``: a directory by the first bits of the hash, the next 32 bits sorted
in each of its buckets, and a byte for the counts, with a dictionary of the usual ones and the
rest apart, in 64 bits):

* ``word``: the hashes of all training words by ranges, with their counts. A word's place in
  all ranges together is its number.
* ``tri``: how often each u v w was seen; ``ctx``: how often u v was seen before a word, and
  how many different words follow it once, twice or more often; ``con``: how many different
  words come before v w (its continuation count).
* ``near``: for each number, how many different words it follows, and of the pairs that it
  begins, how many have a continuation count of one, two or more, and the sum of these.

Trigrams are dealt by their middle word, so that all of u v and all of v w is in one place. A
word with more tokens than a shard should have is dealt by u too; the continuation counts of
its pairs are added up in a second step (``hot``), by pair. Tasks add up what they have seen
before they send it. Nothing but counts of counts and sizes of shards reaches the driver. A
worker that scores looks up the sorted distinct keys of a slice of texts.

With end as a token of its own and two begins that only are context:
p3(w|uv) = (max(c(uvw) - D(c(uvw)), 0) + (D1 n1 + D2 n2 + D3 n3)(uv) p2(w|v)) / c(uv), p2 is
the same of continuation counts over p1, and p1 of the words' own over the uniform 1 / (V + 1).
After a pair that wasn't seen p is p2, after an unknown word p1.

Two keys of a shard agree in all bits that are kept with a chance of about 4e-9 a lookup.

Defined results: a null or empty text is its end token; rows without doc_id are learned from
(their id counts as an empty text for the split) and scored; repeated rows count each; without
training text every token has probability 1 of one unknown word; other columns are ignored.
The vocabulary may have up to 2^32 - 2 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import partitions_for
from .words import WordHashes, chunks, map_shared, mix, pack_longs, pack_sorted, per_doc, range_of, starts, unpack_longs, unpack_sorted, word_arrays, write_shared

END = b"\n"  # no word has white space
SLICE_BYTES, HELD, SPAN = 2 << 20, 1_500_000, 1 << 18
#: Rows of ``near``: words before, and of the pairs begun: continuation counts of 1, 2, 3 or more, and their sum.
NEAR = 5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that they don't have."""

    path: str
    word_sizes: tuple[int, ...]
    n_tokens: int
    n_docs: int
    shards: int
    quota: int
    discounts: tuple[tuple[float, float, float], ...]  # of words, pairs and trigrams
    n_pair_types: int
    word_hist: tuple[int, ...]

    @property
    def n_words(self) -> int:
        return sum(self.word_sizes)


def held_out(doc_id: Column) -> Column:
    """A seventh of the documents, by the CRC of the id's text, isn't learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def discounts(n: tuple[int, ...]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many types were seen once to four times; where that says nothing, 0.5, 1 and 1.5."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) if d > 0 else 0.5 * k for k, d in zip((1, 2, 3), found, strict=True))


def _tokens(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and their number."""
    hashes, lens = word_arrays([t.lower() for t in texts], known)
    return np.insert(hashes, np.cumsum(lens), np.uint64(known[END])), lens + 1


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + mix(b + _B))


def tri_key(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(pair + mix(w * _C + np.uint64(1)))


def shard_of(u: np.ndarray, v: np.ndarray, count: np.ndarray, quota: int, shards: int) -> np.ndarray:
    """Where u v and its trigrams are: the middle word decides, of a hot one also u."""
    parts = np.uint64(1) + count.astype(np.uint64) // np.uint64(quota)
    return (mix(v * _A + mix(u) % parts * _B) % np.uint64(shards)).astype(np.int64)


def hot_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pair) % np.uint64(shards)).astype(np.int64)


# -- sorted hash arrays ----------------------------------------------------------------------


def coded(values: np.ndarray) -> list[np.ndarray]:
    """Rows of 64-bit counts as a byte each: the number of one of 255 usual rows, or 255 and the row itself apart."""
    n, m = values.shape
    bits = 64 // m
    small = (values < np.uint64(1 << min(bits, 63))).all(axis=1)
    key = np.zeros(n, np.uint64)
    for j in range(m):
        key = key << np.uint64(bits if j else 0) | values[:, j]
    kinds, at, count = np.unique(key[small], return_index=True, return_counts=True)
    usual = np.sort(np.argsort(-count, kind="stable")[:255])
    rows = values[np.flatnonzero(small)[at[usual]]].reshape(-1, m)
    place = np.searchsorted(kinds[usual], key) if len(usual) else np.zeros(n, np.int64)
    code = np.full(n, 255, np.uint8)
    inside = np.minimum(place, max(len(usual) - 1, 0))
    hit = small & (kinds[usual][inside] == key) if len(usual) else np.zeros(n, bool)
    code[hit] = inside[hit]
    rest = np.flatnonzero(~hit)
    return [code, rows.astype(np.uint64), rest.astype(np.uint32), values[rest].astype(np.uint64)]


def file_of(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each at a multiple of eight bytes, behind their sizes."""
    head = np.zeros(16, np.int64)
    head[: len(arrays)] = [a.size for a in arrays]
    return b"".join([head.tobytes(), *(x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))])


def arrays_of(raw: np.ndarray, kinds: list[type]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, np.int64, 16), 128, []
    for k, size in zip(kinds, sizes.tolist(), strict=False):
        out.append(np.frombuffer(raw, k, size, at) if size else np.zeros(0, k))
        at += size * np.dtype(k).itemsize + -size * np.dtype(k).itemsize % 8
    return out


class Coded:
    """Rows of counts by their place, from a mapped file."""

    KINDS = [np.uint8, np.uint64, np.uint32, np.uint64]

    def __init__(self, code: np.ndarray, rows: np.ndarray, places: np.ndarray, rest: np.ndarray, m: int):
        self.code, self.rows, self.places, self.rest = code, rows.reshape(-1, m), places, rest.reshape(-1, m)

    @classmethod
    def mapped(cls, path: str, m: int) -> Coded | None:
        raw = map_shared(path, np.uint8)
        return cls(*arrays_of(raw, cls.KINDS), m) if len(raw) else None

    def of(self, at: np.ndarray) -> np.ndarray:
        code = self.code[at]
        out = np.zeros((len(at), self.rows.shape[1]), np.uint64)
        usual = code < 255
        out[usual] = self.rows[code[usual]]
        if not usual.all():
            out[~usual] = self.rest[np.searchsorted(self.places, at[~usual])]
        return out


def table_bytes(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A Table of ascending distinct keys and their rows of counts."""
    bits = max(0, len(keys).bit_length() - 5)
    top = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    directory = np.searchsorted(top, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    return file_of([*coded(values), directory, rest])


class Table:
    """Counts by key, from a mapped file."""

    def __init__(self, path: str, m: int):
        raw, self.m = map_shared(path, np.uint8), m
        *code, self.directory, self.rest = arrays_of(raw, [*Coded.KINDS, np.uint32, np.uint32]) if len(raw) else [np.zeros(0, np.uint8)] * 6
        self.counts = Coded(*code, m)
        self.bits = max(len(self.directory) - 1, 1).bit_length() - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, zeros of those that aren't there; ascending keys read the file in order."""
        out = np.zeros((len(keys), self.m), np.uint64)
        if not len(self.rest):
            return out
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low, end = self.directory[bucket].astype(np.int64), self.directory[bucket + 1].astype(np.int64)
        want, high = (keys << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32), end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self.rest[middle] < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        hit = np.flatnonzero(low < end)
        hit = hit[self.rest[low[hit]] == want[hit]]
        out[hit] = self.counts.of(low[hit])
        return out


# -- counting ----------------------------------------------------------------------------------


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal neighbours begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, the sums of their counts, and what else goes with a key."""
    order = np.argsort(keys)  # of equal keys any order will do
    keys, counts = keys[order], counts[order]
    begin = _runs(keys)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts, *(x[order[begin]] for x in more)


class _Sums:
    """Counts of keys that a task has seen, with columns that go with a key; sent when there are many."""

    def __init__(self, send):
        self.pack, self.held, self.n = send, [], 0

    def add(self, keys: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _summed(keys, np.ones(len(keys), np.uint64), *more)
        self.held.append(own)
        self.n += len(own[0])
        if self.n > HELD:
            now = _summed(*map(np.concatenate, zip(*self.held, strict=True)))
            self.held, self.n = [now], len(now[0])
            if self.n > HELD // 2:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            now = _summed(*map(np.concatenate, zip(*self.held, strict=True)))
            self.held, self.n = [], 0
            yield from self.pack(*now)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a shard number that ascends."""
    cut = _runs(shard).tolist()
    return ((int(shard[b]), slice(b, e)) for b, e in zip(cut, [*cut[1:], len(shard)], strict=False))


def narrow(shard: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers in 16 bits where they fit, which are sorted by counting."""
    return shard.astype(np.uint16) if shards <= 1 << 16 else shard


class Words:
    """The numbers and counts of words, from the mapped files."""

    def __init__(self, path: str, sizes: tuple[int, ...]):
        self.path, self.sizes, self.first = path, sizes, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.files: dict[int, tuple[np.ndarray, Coded]] = {}

    def file(self, s: int) -> tuple[np.ndarray, Coded]:
        if s not in self.files:
            self.files[s] = map_shared(f"{self.path}/word/{s}.keys", np.uint64), Coded.mapped(f"{self.path}/word/{s}.counts", 1)
        return self.files[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of sorted distinct hashes; -1 and 0 of an unknown word."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.uint64)
        edges = np.searchsorted(range_of(hashes, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if not self.sizes[s]:
                continue
            keys, counts = self.file(s)
            asked = hashes[edges[s] : edges[s + 1]]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == asked)
            number[edges[s] + hit] = at[hit] + self.first[s]
            count[edges[s] + hit] = counts.of(at[hit])[:, 0]
        return number, count

    def counts(self, numbers: np.ndarray, n_docs: int) -> np.ndarray:
        """The counts of ascending numbers; the begin, behind all words, has one for each text."""
        out = np.full(len(numbers), n_docs, np.uint64)
        edges = np.searchsorted(numbers, self.first)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            out[edges[s] : edges[s + 1]] = self.file(s)[1].of(numbers[edges[s] : edges[s + 1]] - self.first[s])[:, 0]
        return out


def before(number: np.ndarray, lens: np.ndarray, begin: int) -> np.ndarray:
    """The number of the word before each token; a text's first one has the begin before it."""
    out = np.concatenate(([0], number[:-1])).astype(number.dtype) if len(number) else number.copy()
    out[starts(lens)] = begin
    return out


PACKED = "shard int, keys binary, more binary, counts binary"
ROWS = "kind int, part int, turn int, slot int, keys binary, counts binary"
_NEAR, _HOT, _HIST = 0, 1, 2


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _hist(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4, and how many there are."""
    return np.array([*(np.count_nonzero(counts == k) for k in (1, 2, 3, 4)), len(counts)], np.uint64)


def _near_rows(slot: int, ids: np.ndarray, counts: np.ndarray, turn: int) -> list[tuple]:
    """What is to be added to one column of ``near``, by spans of numbers; ids ascend. Rows of a span are added up by turns, then together."""
    return [(_NEAR, span, turn, slot, pack_sorted(ids[own]), pack_longs(counts[own])) for span, own in _by_shard((ids // np.uint64(SPAN)).astype(np.int64))]


def _pair_stats(v: np.ndarray, w: np.ndarray, cont: np.ndarray, turn: int = 0) -> list[tuple]:
    """Rows for ``near`` of distinct pairs v w with all of their continuation count; v ascends."""
    begin, out = _runs(v), []
    ids = v[begin]
    if not len(ids):
        return out
    for slot, is_ in ((1, cont == 1), (2, cont == 2), (3, cont >= 3)):
        n = np.add.reduceat(is_.astype(np.uint64), begin)
        out += _near_rows(slot, ids[n > 0], n[n > 0], turn)
    out += _near_rows(4, ids, np.add.reduceat(cont, begin), turn)
    follows, n = np.unique(w, return_counts=True)
    return out + _near_rows(0, follows, n.astype(np.uint64), turn)


def train(docs: DataFrame, path: str) -> Model:
    """Counts the texts of docs and stores the model at ``path``, a folder that all executors share."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    shards = partitions_for(docs)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = [(s, pack_sorted(keys[own]), b"", pack_longs(counts[own])) for s, own in _by_shard(range_of(keys, shards))]
            yield from _table(out, PACKED).to_batches()

        known, sums = WordHashes(), _Sums(send)
        for _, texts in chunks(batches, limit=SLICE_BYTES):
            yield from sums.add(_tokens(texts, known)[0])
        yield from sums.send()

    def store_words(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _summed(np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()]), np.concatenate([unpack_longs(x) for x in table["counts"].to_pylist()]))
        write_shared(f"{path}/word/{shard}.keys", keys.tobytes())
        write_shared(f"{path}/word/{shard}.counts", file_of(coded(counts[:, None])))
        ends = int(counts[keys == np.uint64(WordHashes()[END])].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())], "ends": [ends]})

    sizes = {r[0]: r[1:] for r in rows.mapInArrow(count_words, PACKED).groupBy("shard").applyInArrow(store_words, "shard int, types long, tokens long, ends long").collect()}
    word_sizes = tuple(sizes.get(s, (0,))[0] for s in range(shards))
    n_words, n_tokens, n_docs = sum(word_sizes), sum(x[1] for x in sizes.values()), sum(x[2] for x in sizes.values())
    if n_words >= 2**32 - 1:
        raise ValueError(f"{n_words} different words; numbers have 32 bits")
    quota = max(1, n_tokens // shards)
    half, turns = np.uint64(32), isqrt(shards) + 1

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = WordHashes(), Words(path, word_sizes)

        def send(_: np.ndarray, counts: np.ndarray, pair: np.ndarray, w: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(pair)
            order = order[np.argsort(narrow(shard[order], shards), kind="stable")]
            counts, pair, w, shard = counts[order], pair[order], w[order], shard[order]
            for s, own in _by_shard(shard):
                yield from _table([(s, pack_sorted(pair[own]), w[own].view(np.uint8).reshape(-1, 4).T.tobytes(), pack_longs(counts[own]))], PACKED).to_batches()

        sums = _Sums(send)
        for _, texts in chunks(batches, limit=SLICE_BYTES):
            hashes, lens = _tokens(texts, known)
            asked, back = np.unique(hashes, return_inverse=True)
            number, count = words.find(asked)
            w = number[back].astype(np.uint64)
            v, of_v = before(w, lens, n_words), before(count[back], lens, n_docs)
            u = before(v, lens, n_words)
            yield from sums.add(tri_key(pair_key(u, v), w), v << half | u, w.astype(np.uint32), shard_of(u, v, of_v, quota, shards).astype(np.int32))
        yield from sums.send()

    def store_trigrams(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        turn = shard % turns
        pair, counts = (np.concatenate([f(x) for x in table[c].to_pylist()]) for c, f in (("keys", unpack_sorted), ("counts", unpack_longs)))
        w = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in table["more"].to_pylist()])
        low = np.uint64((1 << 32) - 1)
        keys, counts, pair, w = _summed(tri_key(pair_key(pair & low, pair >> half), w.astype(np.uint64)), counts, pair, w)
        write_shared(f"{path}/tri/{shard}", table_bytes(keys, counts[:, None]))
        out = [(_HIST, 0, turn, 3, b"", pack_longs(_hist(counts)))]
        # contexts
        order = np.argsort(pair, kind="stable")
        own, c = pair[order], counts[order]
        begin = _runs(own)
        seen = np.stack([np.add.reduceat(x, begin) for x in (c, *((y).astype(np.uint64) for y in (c == 1, c == 2, c >= 3)))], axis=1)
        key = pair_key(own[begin] & low, own[begin] >> half)
        order = np.argsort(key)
        write_shared(f"{path}/ctx/{shard}", table_bytes(key[order], seen[order]))
        # continuations: each u of v w once
        both, cont = _summed(pair >> half << half | w.astype(np.uint64), np.ones(len(w), np.uint64))
        v, w = both >> half, both & low
        begin = _runs(v)
        hot = np.repeat(Words(path, word_sizes).counts(v[begin].astype(np.int64), n_docs) >= quota, np.diff(begin, append=len(v)))
        key = pair_key(v, w)
        if hot.any():
            part = hot_shard(key[hot], shards)
            order = np.argsort(part, kind="stable")
            mine, n = both[hot][order], cont[hot][order]
            out += [(_HOT, p, 0, 0, pack_sorted(mine[x]), pack_longs(n[x])) for p, x in _by_shard(part[order])]
        v, w, cont, key = (x[~hot] for x in (v, w, cont, key))
        order = np.argsort(key)
        write_shared(f"{path}/con/{shard}", table_bytes(key[order], cont[order][:, None]))
        out += [*_pair_stats(v, w, cont, turn), (_HIST, 0, turn, 2, b"", pack_longs(_hist(cont)))]
        return _table(out, ROWS)

    def store_hot(table: pa.Table) -> pa.Table:
        """Continuations of hot words by pair; what ``near`` gets from several shards is added up on the way."""
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        if kind == _HIST:
            return table
        keys, slot = [unpack_sorted(x) for x in table["keys"].to_pylist()], table["slot"].to_numpy()
        counts = [unpack_longs(x) for x in table["counts"].to_pylist()]
        if kind == _NEAR:
            out = []
            for k in np.unique(slot).tolist():
                mine = np.flatnonzero(slot == k)
                out.append((_NEAR, part, 0, k, *(f(x) for f, x in zip((pack_sorted, pack_longs), _summed(np.concatenate([keys[i] for i in mine]), np.concatenate([counts[i] for i in mine])), strict=True))))
            return _table(out, ROWS)
        both, cont = _summed(np.concatenate(keys), np.concatenate(counts))
        v, w = both >> half, both & np.uint64((1 << 32) - 1)
        key = pair_key(v, w)
        order = np.argsort(key)
        write_shared(f"{path}/hot/{part}", table_bytes(key[order], cont[order][:, None]))
        return _table([*_pair_stats(v, w, cont), (_HIST, 0, 0, 2, b"", pack_longs(_hist(cont)))], ROWS)

    def store_near(table: pa.Table) -> pa.Table:
        span, hists = table["part"][0].as_py(), {2: np.zeros(5, np.int64), 3: np.zeros(5, np.int64)}
        near = np.zeros((min(SPAN, n_words + 1 - span * SPAN), NEAR), np.uint64)
        for kind, _, _, slot, keys, counts in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if kind == _HIST:
                hists[slot] += unpack_longs(counts).astype(np.int64)
            else:
                near[unpack_sorted(keys).astype(np.int64) - span * SPAN, slot] += unpack_longs(counts)
        write_shared(f"{path}/near/{span}", file_of(coded(near)))
        seen = [*(int((near[:, 0] == k).sum()) for k in (1, 2, 3, 4)), int((near[:, 0] >= 3).sum())]
        return pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in (("words", seen), ("pairs", hists[2].tolist()), ("trigrams", hists[3].tolist()))})

    counted = rows.mapInArrow(count_trigrams, PACKED).groupBy("shard").applyInArrow(store_trigrams, ROWS)
    summed = counted.groupBy("kind", "part", "turn").applyInArrow(store_hot, ROWS)
    found = summed.groupBy("part").applyInArrow(store_near, "words array<long>, pairs array<long>, trigrams array<long>").collect()
    words, pairs, trigrams = (tuple(sum(r[k][i] for r in found) for i in range(5)) for k in ("words", "pairs", "trigrams"))
    return Model(path, word_sizes, n_tokens, n_docs, shards, quota, (discounts(words[:4]), discounts(pairs[:4]), discounts(trigrams[:4])), pairs[4], words)


# -- scoring -----------------------------------------------------------------------------------


class Scorer:
    """A model as a worker maps it."""

    def __init__(self, model: Model):
        self.m, self.words, self.known = model, Words(model.path, model.word_sizes), WordHashes()
        self.tables: dict[tuple[str, int], Table] = {}
        self.spans: dict[int, Coded] = {}

    def near(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of ``near`` of ascending numbers."""
        out = np.zeros((len(numbers), NEAR), np.float64)
        for s, own in _by_shard(numbers // SPAN):
            if s not in self.spans:
                self.spans[s] = Coded.mapped(f"{self.m.path}/near/{s}", NEAR)
            out[own] = self.spans[s].of(numbers[own] - s * SPAN)
        return out

    def find(self, name: str, keys: np.ndarray, shard: np.ndarray, m: int) -> np.ndarray:
        """Rows of a table's keys, which lie in these shards; each key is looked up once."""
        out = np.zeros((len(keys), m), np.float64)
        bits = np.uint64(max(1, (self.m.shards - 1).bit_length()))
        order = np.argsort(shard.astype(np.uint64) << np.uint64(64) - bits | keys >> bits)
        for s, own in _by_shard(shard[order]):
            if (name, s) not in self.tables:
                self.tables[name, s] = Table(f"{self.m.path}/{name}/{s}", m)
            mine = keys[order[own]]
            begin = _runs(mine)
            out[order[own]] = np.repeat(self.tables[name, s].find(mine[begin]), np.diff(begin, append=len(mine)), axis=0)
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base and model log10 probability of each text."""
        m = self.m
        hashes, lens = _tokens(texts, self.known)
        asked, back = np.unique(hashes, return_inverse=True)
        number, count = self.words.find(asked)
        base = np.log10((count + 1.0) / (m.n_tokens + m.n_words + 1))
        known = number >= 0
        rows = np.zeros((len(asked), NEAR))
        rows[known] = self.near(number[known])  # numbers ascend with the hashes
        d1, d2, d3 = (np.concatenate(([0.0], d)) for d in m.discounts)
        less = lambda c, d: np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
        total, h = float(m.n_pair_types), m.word_hist
        gamma = (d1[1] * h[0] + d1[2] * h[1] + d1[3] * h[4]) / total if total else 1.0
        single = gamma / (m.n_words + 1) + (less(rows[:, 0], d1) / total if total else 0)
        begin = self.near(np.array([m.n_words]))[0] if m.n_docs else np.zeros(NEAR)
        n, none = len(asked), np.int64(m.n_words)
        # tokens by their place among the asked ones; n is the begin
        w = back
        v = before(w, lens, n)
        u = before(v, lens, n)
        number, count, rows = np.append(number, none), np.append(count, np.uint64(m.n_docs)), np.vstack((rows, begin))
        p = single[w].copy()
        # pairs
        some = np.flatnonzero((number[v] >= 0) & (rows[v, 4] > 0))
        nv, nw, of_v = number[v[some]].astype(np.uint64), number[w[some]], count[v[some]]
        seen = np.zeros(len(some))
        hit = np.flatnonzero(nw >= 0)
        key = pair_key(nv[hit], nw[hit].astype(np.uint64))
        hot = of_v[hit] >= np.uint64(m.quota)
        for name, is_, shard in (("con", ~hot, shard_of(np.zeros(len(hit), np.uint64), nv[hit], np.zeros(len(hit)), m.quota, m.shards)), ("hot", hot, hot_shard(key, m.shards))):
            seen[hit[is_]] = self.find(name, key[is_], shard[is_], 1)[:, 0]
        r = rows[v[some]]
        p[some] = (less(seen, d2) + (r[:, 1:4] @ d2[1:]) * p[some]) / r[:, 4]
        # trigrams
        some = np.flatnonzero((number[v] >= 0) & (number[u] >= 0) & (m.n_docs > 0))
        nu, nv, nw = number[u[some]].astype(np.uint64), number[v[some]].astype(np.uint64), number[w[some]]
        key, shard = pair_key(nu, nv), shard_of(nu, nv, count[v[some]], m.quota, m.shards)
        ctx = self.find("ctx", key, shard, 4)
        met = ctx[:, 0] > 0
        some, key, shard, nw, ctx = some[met], key[met], shard[met], nw[met], ctx[met]
        seen = np.zeros(len(some))
        hit = np.flatnonzero(nw >= 0)
        seen[hit] = self.find("tri", tri_key(key[hit], nw[hit].astype(np.uint64)), shard[hit], 1)[:, 0]
        p[some] = (less(seen, d3) + (ctx[:, 1:] @ d3[1:]) * p[some]) / ctx[:, 0]
        return lens, per_doc(known[back], lens), per_doc(base[back], lens), per_doc(np.log10(p), lens)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in chunks(batches, limit=SLICE_BYTES):
            lens, known, base, own = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(10 ** (-own / lens), pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
