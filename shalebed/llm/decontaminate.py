"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and their case; numbers, names (capitalised inside a
sentence) and units (after a number) become typed placeholders. Windows of ``WINDOW`` template
words of the benchmark are hashed, and the windows of all documents are joined with them by
hash. Hits on one alignment of a document and an item form a match; its slots are then read
again: equal values of the item have to stand for equal values in the document, in each type;
two values of the item may have become one. A capitalised word that begins a sentence may be a
name or not, so windows are hashed both ways; where it differs it is a slot, which is left out
if it collides, unless the item has it as a name elsewhere.
So an item that was copied, and one that was asked again with other numbers and names, are
found, and a text that only has the same shape isn't.

Where equal values don't stand for equal ones, the windows with these slots are left out, and
the rest of the match counts if it is verbatim.

A document is contaminated by an item if consistent matches cover ``ENOUGH`` of its words (of
a shorter item, all but two) and half of these are literal or names and units that are the
same, or if matches without any other value cover so many.

The benchmark is a stated query set. Its windows become a table and a bitmap of a bounded size;
a pass over the documents gives the windows that the bitmap doesn't exclude, with their slots,
and Spark joins these with the table by hash, so that the benchmark may have any size. Items
and texts meet once for each distinct text. What is found is tied to documents by two hashes
of the text.

Defined results: null and empty texts have no windows, on either side; an item with fewer
words than a window is one window; rows without doc_id or item_id are reported with a null;
repeated rows are reported once each; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .words import chunks, content_key, per_doc, starts, windows, without_content

#: Words of a window, words that make a leak, and for how many windows the bitmap has 64 bits each; more share them.
WINDOW, ENOUGH, BLOCK = 8, 13, 1 << 24

#: Units of measure and money.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons ms s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years percent % $ € £ usd eur gbp dollar dollars euro euros cent cents kmh mph kph hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal c f k degree degrees".split())
LITERAL, NUMBER, NAME, UNIT = range(4)
NUMBERS = re.compile(r"\d[\d.,:/'-]*(?:st|nd|rd|th|%)?", re.I)
EDGES = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$|^[_$€£%]+(?=.)|(?<=.)[_$€£%]+$")


def core_of(text: str) -> str:
    """A word without what stands around it; a sign of money or percent that stands alone stays."""
    if text.isalnum():
        return text
    core = text.strip(string.punctuation)
    if core and core[0].isalnum() and core[-1].isalnum():
        return core
    core = text
    while (less := EDGES.sub("", core)) != core:
        core = less
    return core


class Lexicon(dict):
    """What a word is by itself: a row of ``table`` (hash of its core, kind, whether a sentence ends with it)."""

    ROW = np.dtype([("value", np.uint64), ("kind", np.int8), ("ends", bool)])
    limit = 200_000

    def __init__(self):
        super().__init__()
        self.table = np.zeros(0, self.ROW)
        self.new: list[tuple[int, int, bool]] = []

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = core_of(text)
        low = core.lower()
        first = core[:1]
        kind = NUMBER if first.isdigit() and NUMBERS.fullmatch(core) else UNIT if low in UNITS else NAME if first.isupper() and core[1:].islower() else LITERAL
        if not first.isalnum() and low not in UNITS:
            low = ""
        self[word] = len(self)
        self.new.append((xxhash.xxh3_64_intdigest(low.encode()) if low else 0, kind, text.rstrip("\"'”’)]")[-1:] in (".", "!", "?", ":", "…")))
        return self[word]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, the same with sentence beginnings as names, kind and value hash of the words of all texts, and how many each has; words without a core are left out."""
        if len(self) > self.limit:
            self.clear()
            self.table = self.table[:0]
        split = [t.split() for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(self.__getitem__, [w for words in split for w in words]), np.int64, int(lens.sum()))
        self.table = np.concatenate((self.table, np.array(self.new, self.ROW)))
        self.new.clear()
        table = self.table[ids]
        value, kind, ends = table["value"], table["kind"].copy(), table["ends"]
        begins = np.concatenate(([True], ends[:-1])) if len(ids) else np.zeros(0, bool)
        begins[starts(lens)[lens > 0]] = True
        after_number = np.concatenate(([False], kind[:-1] == NUMBER)) if len(ids) else begins
        first = (kind == NAME) & begins
        kind[first | ((kind == UNIT) & ~after_number)] = LITERAL
        some = value != 0
        template = np.where(kind == LITERAL, value, kind.astype(np.uint64))
        named = np.where(first, np.uint64(NAME), template)
        return template[some], named[some], kind[some], value[some], per_doc(some, lens)


def both_windows(template: np.ndarray, named: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows, those with a sentence's beginning a second time with it as a name."""
    (at, h), (_, other) = windows(template, lens, n), windows(named, lens, n)
    more = np.nonzero(h != other)[0]
    return np.concatenate((at, at[more])), np.concatenate((h, other[more]))


def _windows_of(template: np.ndarray, named: np.ndarray, lens: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, position, hash) for each size; of sizes below WINDOW only whole texts are windows of an item."""
    for n in sizes:
        yield n, *both_windows(template, named, lens, n)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon()
    for batch, texts in chunks(batches):
        template, named, kind, value, lens = lexicon.read(texts)
        begin, rows = starts(lens), []
        of = np.repeat(np.arange(len(lens)), lens)
        found: list[list[list]] = [[] for _ in texts]
        for n, at, h in _windows_of(template, named, lens, sorted({min(int(k), WINDOW) for k in lens if k})):
            for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                if n == WINDOW or lens[of[i]] == n:
                    found[of[i]].append({"h": x, "size": n, "pos": i - int(begin[of[i]])})
        for d, (b, n) in enumerate(zip(begin.tolist(), lens.tolist(), strict=True)):
            rows.append((n, kind[b : b + n].tobytes(), value[b : b + n].tobytes(), found[d]))
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())]))), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *made], ["item", "item_id", "n", "kinds", "values", "windows"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, kinds, values, windows) of every row of the benchmark, which item numbers."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "item long, item_id long, n int, kinds binary, values binary, windows array<struct<h: long, size: int, pos: int>>"
    return stored(rows.mapInArrow(_items, schema), "items")


def bitmap_of(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with two bits set for each window's hash, as bytes, and the mask of its positions: 2^20 to 2^30 bits."""
    n = min(windows.count(), BLOCK)
    mask = (1 << min(30, max(20, (64 * n - 1).bit_length() if n else 0))) - 1
    places = windows.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 34).bitwiseAND(F.lit(mask)))).alias("at")).select((F.col("at") + 1).alias("at"))
    parts = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((mask + 1) // 8, np.uint8)
    for bucket, bits in parts.toLocalIterator():
        own = np.frombuffer(bytes(bits), np.uint8)
        begin = (bucket - 1) * len(own)
        out[begin : begin + len(own)] = own[: len(out) - begin]
    return out, mask


def _candidates(bitmap, mask: int, sizes: list[int]):
    """The windows of texts that the bitmap doesn't exclude, with kinds and values of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, bits, low = Lexicon(), bitmap.value, np.uint64(mask)
        isset = lambda p: bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1
        for batch, texts in chunks(batches):
            template, named, kind, value, lens = lexicon.read(texts)
            begin, doc = starts(lens), np.repeat(np.arange(len(lens)), lens)
            for n, at, h in _windows_of(template, named, lens, sizes):
                at, h = (x[np.flatnonzero(isset(h & low))] for x in (at, h))
                at, h = (x[np.flatnonzero(isset(h >> np.uint64(34) & low))] for x in (at, h))
                if not len(at):
                    continue
                own = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([
                    batch.column("key_a").take(own), batch.column("key_b").take(own), pa.array(h.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array((at - begin[doc[at]]).astype(np.int64)),
                    pa.array([kind[i : i + n].tobytes() for i in at.tolist()], pa.binary()), pa.array([value[i : i + n].tobytes() for i in at.tolist()], pa.binary()),
                ], ["key_a", "key_b", "h", "size", "at", "own_kinds", "own_values"])

    return run


def judge(kinds: list[int], values: list[int], matches: dict[int, dict[int, int]]) -> tuple[int, int, bool] | None:
    """Words covered, slots with another value and whether all is verbatim; None if it isn't a leak.

    matches: for each alignment (document position of the item's first word), the document's
    values at the item positions that its windows cover.
    """
    n = len(kinds)
    size = min(n, WINDOW)
    covered, same, equal, changed = set(), set(), set(), 0
    names = {v for v, k in zip(values, kinds, strict=True) if k == NAME}

    def read(there: dict[int, int], places: set[int]) -> tuple[set[int], int, set[int], set[int], set[int]]:
        """Slots that collide, slots with another value, words that speak for the item, slots left out, sentence beginnings that differ."""
        first_of, wrong, others, words, begins = {}, set(), 0, set(), []
        other = {p for p in places if kinds[p] == LITERAL and values[p] != there[p]}
        for p in sorted(places):
            mine, k, theirs = values[p], kinds[p], there[p]
            if k == LITERAL and p not in other:
                words.add(p)
            elif k == LITERAL and mine not in names:
                begins.append((p, mine, theirs))
            else:
                k = k or NAME
                if first_of.setdefault((k, mine), theirs) != theirs:
                    wrong.add((k, mine))
                others += mine != theirs
                if mine == theirs and k != NUMBER:
                    words.add(p)
        left_out = {p for p, mine, theirs in begins if first_of.setdefault((NAME, mine), theirs) != theirs}
        collide = {p for p in places if (kinds[p] or NAME, values[p]) in wrong and (kinds[p] != LITERAL or p in other)}
        return collide, others + len(begins) - len(left_out), words, left_out, other

    def without(places: set[int], bad: set[int]) -> set[int]:
        """What windows cover that have none of these positions."""
        return {q for p in places if all(x in places and x not in bad for x in range(p, p + size)) for q in range(p, p + size)}

    for there in matches.values():
        places = set(there)
        collide, others, words, left_out, other = read(there, places)
        if collide and other:  # sentence beginnings as literals
            places = without(places, other)
            collide, others, words, left_out, other = read(there, places)
        if collide:
            places = without(places, collide)
            collide, others, words, left_out, other = read(there, places)
            if others or left_out:
                continue
        if not collide:
            covered |= places - left_out
            same |= words
            equal |= places if not others and not left_out else set()
            changed += others
    need = min(ENOUGH, max(1, n - 2))
    if len(covered) < need or 2 * len(same) < len(covered) and len(equal) < need:
        return None
    return len(covered), changed, changed == 0


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, out = [], []
        for i, (kinds, values, hits) in enumerate(zip(batch.column("kinds").to_pylist(), batch.column("values").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
            matches: dict[int, dict[int, int]] = defaultdict(dict)
            for hit in hits:
                for k, v in enumerate(np.frombuffer(hit["own_values"], np.uint64).tolist()):
                    matches[hit["shift"]][hit["pos"] + k] = v
            if said := judge(np.frombuffer(kinds, np.int8).tolist(), np.frombuffer(values, np.uint64).tolist(), dict(sorted(matches.items()))):
                keep.append(i)
                out.append(said)
        if keep:
            rows = batch.take(pa.array(keep))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("key_a", "key_b", "item", "item_id")), rows.column("n").cast(pa.int64()), *made], ["key_a", "key_b", "item", "item_id", "n_item_words", "n_covered", "n_changed_slots", "verbatim"])


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key_a, key_b, item, item_id, ...): each distinct text that holds an item, once for each row of the benchmark."""
    spark = docs.sparkSession
    items = items_of(benchmark)
    windows = items.select("item", F.explode("windows").alias("w")).select("item", "w.h", "w.size", "w.pos")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    bits, mask = bitmap_of(windows)
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), *content_key(F.coalesce(text, F.lit(""))))
    near = rows.mapInArrow(_candidates(spark.sparkContext.broadcast(bits), mask, sizes), "key_a long, key_b long, h long, size int, at long, own_kinds binary, own_values binary")
    hits = near.join(windows, ["h", "size"]).select("key_a", "key_b", "item", (F.col("at") - F.col("pos")).alias("shift"), "pos", "own_values")
    once = hits.groupBy("key_a", "key_b", "item", "shift", "pos").agg(F.first("own_values").alias("own_values"))
    pairs = once.groupBy("key_a", "key_b", "item").agg(F.collect_list(F.struct("shift", "pos", "own_values")).alias("hits"))
    judged = pairs.join(items.drop("windows"), "item").select("key_a", "key_b", "item", "item_id", "n", "kinds", "values", "hits")
    return judged.mapInArrow(_judged, "key_a long, key_b long, item long, item_id long, n_item_words long, n_covered long, n_changed_slots long, verbatim boolean")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words, n_changed_slots and verbatim of each contaminated document and its item."""
    known = stored(found(docs, benchmark), "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(known, ["key_a", "key_b"]).select("doc_id", "item_id", "n_covered", "n_item_words", "n_changed_slots", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates; a row is judged by its text, so rows without a doc_id are judged too."""
    return without_content(docs, stored(found(docs, benchmark).select("key_a", "key_b").distinct(), "leaks"))
