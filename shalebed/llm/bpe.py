"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a slice of a partition's texts (1 MB, or one longer text) are laid out
one after another as symbols. An index maps each pair that has a merge to all its positions
there; a slice at a time, as the index of a whole partition has no bound. Active ranks are applied in
ascending order: every listed position of the pair that still holds it is merged, and the
lists of the pairs that this makes at its two sides are extended. Pieces that were encoded
before are remembered for as long as the memory is small.

The vocabulary is a file of the tokenizers library: NFC, white space to one space, lower case,
a pattern that splits pieces, byte-level symbols with an end-of-word suffix, no decoder (then
decoding joins token strings by a space). Special tokens found in a text stand for themselves.

Defined results: a null or empty text has no tokens and decodes to an empty text; each row is
encoded on its own, so repeated rows and ids are no special case; other columns pass through,
but for input columns with the names of the results, n_tokens, ids and decoded, which these
replace.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

#: The characters with the White_Space property.
SPACE = r"\t\n\x0b\f\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    limit = 150_000

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, (split, _) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | added).items()}
        symbols = byte_symbols()
        self.inner, self.last = ([vocab[s + x] for s in symbols] for x in ("", end))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 16 | vocab[b]: r for r, (a, b) in enumerate(merges)}  # ids fit in 16 bits
        if max(self.strings, default=0) >> 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.sorted = np.array(sorted(self.ranks), np.int64)
        self.sorted_ranks = np.array([self.ranks[k] for k in self.sorted.tolist()], np.int64)
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.first_use: dict[int, int] = {}
        for r in range(len(self.pairs) - 1, -1, -1):
            self.first_use[self.pairs[r][0]] = self.first_use[self.pairs[r][1]] = r
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.begins = os.path.commonprefix(list(added))  # of every special token
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a special token is a piece of its own."""
        if self.special and self.begins in text and (parts := self.special.split(text))[1:]:
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        # each character is lowered by itself: only a capital sigma depends on its neighbours
        return self.pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that aren't known yet, all at once."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        symbols, ends, inner = [], [], self.inner
        for p in new:
            raw = p.encode()
            symbols += [inner[b] for b in raw[:-1]]
            symbols += (self.last[raw[-1]], -1)
            ends.append(len(symbols))
        ids = np.array(symbols, np.int64)
        self.merge(ids)
        kept = ids >= 0
        packed, to = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept)[np.array(ends, np.int64) - 1]).tolist()
        for p, b, e in zip(new, [0, *to], to, strict=False):
            self.known[p] = packed[b:e]

    def ranked(self, pairs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(rank, places) of the pairs that have a merge."""
        at = np.minimum(np.searchsorted(self.sorted, pairs), len(self.sorted) - 1)
        found = np.flatnonzero(self.sorted[at] == pairs)
        rank = self.sorted_ranks[at[found]]
        order = np.argsort(rank, kind="stable")
        places, rank = places[found[order]], rank[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        return ((r, places[b:e].tolist()) for r, b, e in zip(rank[cut].tolist(), cut, [*cut[1:], len(rank)], strict=False))

    def merge(self, symbols: np.ndarray) -> None:
        """Applies all merges in place; -1 ends a piece, -2 marks a symbol that was merged away."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        view, next_, last = memoryview(symbols), memoryview(after), memoryview(before)
        rank_of = self.ranks.get
        where = defaultdict(list, self.ranked(symbols[:-1] << 16 | symbols[1:], np.arange(n - 1))) if n else {}
        active = list(where)
        heapq.heapify(active)

        def add(q: int, places: list[int]) -> None:
            if q not in where:
                heapq.heappush(active, q)
            where[q] += places

        while active:
            r = heapq.heappop(active)
            places = where.pop(r, None)
            if not places:
                continue
            a, b, made = self.pairs[r]
            if len(places) > 48 and a != b and self.first_use.get(made, r) >= r:  # apart from each other, and nothing comes before
                i = np.unique(places)
                j = after[i]
                same = (symbols[i] == a) & (symbols[np.minimum(j, n - 1)] == b)
                i, j = i[same], j[same]
                symbols[i], symbols[j] = made, -2
                right = after[j]
                after[i], before[right] = right, i
                left = before[i]
                for q, new in self.ranked(np.concatenate((np.where(left < 0, -1, symbols[left] << 16 | made), made << 16 | symbols[right])), np.concatenate((left, i))):
                    add(q, new)
                continue
            places.sort()
            for k, i in enumerate(places):
                j = next_[i]
                if view[i] != a or j >= n or view[j] != b:
                    continue
                view[i], view[j] = made, -2
                next_[i] = right = next_[j]
                last[right] = i
                left, lower = last[i], False
                if left >= 0 and (q := rank_of(view[left] << 16 | made)) is not None:
                    add(q, [left])
                    lower = q < r
                if (q := rank_of(made << 16 | view[right])) is not None:
                    add(q, [i])
                    lower |= q < r
                if lower and k + 1 < len(places):  # a lower rank comes first, the rest of this list after it
                    add(r, places[k + 1 :])
                    break

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn({p for pieces in split for p in pieces} - self.added.keys())
        ids = {**self.known, **self.added} if any(not self.added.keys().isdisjoint(p) for p in split) else self.known
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        return [" ".join(map(self.strings.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


_models: dict[str, Bpe] = {}


def model_of(spec: str) -> Bpe:
    """The model of a worker, made once for all its tasks."""
    if spec not in _models:
        _models.clear()
        _models[spec] = Bpe(spec)
    return _models[spec]


def read_spec(path: str) -> str:
    """The vocabulary file's text, read on the driver; it is of a fixed size and goes out with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """All columns of docs but text, then n_tokens, ids (binary) and decoded, the text that the ids give."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    own = ["n_tokens", "ids", *["decoded"] * decoded]
    rest = [c for c in docs.columns if c not in {"text", *own}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(spec.value)
        for batch, texts in chunks(batches):
            ids = model.encode([t.decode("utf-8", "replace") for t in texts])
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            made += [pa.array(model.decode(ids), pa.string())] * decoded
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, *own])

    rows = docs.select(*rest, F.col("text").cast("string").alias("text"))
    kept = rows.select(*rest).schema
    return rows.mapInArrow(run, kept.add("n_tokens", "long").add("ids", "binary").add("decoded", "string") if decoded else kept.add("n_tokens", "long").add("ids", "binary"))
