"""The operators against brute force, and their defined results at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shalebed.llm import bpe, chat, decontaminate, html_text, kneser_ney, near_dedup, passages, quality, sharding, url_filters, words
from shalebed.llm.queries import tokenizer_path
from shalebed.storage import scratch

LONG = " ".join(f"w{i % 700}x{i // 3}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
EDGES = [
    (1, "", "a"), (2, None, "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, BASE, "c"), (6, BASE, "c"), (7, BASE, "c"), (8, BASE + " more words here", "c"),
    (9, BASE.upper(), "d"), (None, BASE, "d"), (None, None, None), (10, LONG, "e"), (11, LONG + " end", "e"), (12, "é ü\x0bß\x0cx 日本", "f"), (13, "a\x85b c\xa0d", "f"), (14, "one", "b"), (15, "x " * 300, "g"), (16, "x " * 299 + "y", "g"), (-3, BASE.replace("tok5 ", "TOK5 "), "h"),
]
SCHEMA = "doc_id long, text string, slot string"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empties, a long text, ties, repeated rows, and a column whose name clashes with an operator's own."""
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- words -----------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \t\n\x0b\x0c\r\x1c\x85\xa0é", max_size=30), max_size=8), st.integers(1, 4))
def test_windows(texts, n):
    hashes, lens = words.word_arrays([t.encode() for t in texts], words.WordHashes())
    assert lens.tolist() == [len(split(t)) for t in texts]
    at, h = words.windows(hashes, lens, n)
    flat = [w for t in texts for w in split(t)]
    begin = words.starts(lens)
    want = [int(b) + k for b, m in zip(begin, lens) for k in range(m - n + 1)]
    assert at.tolist() == want
    seen = defaultdict(set)
    for i, x in zip(at.tolist(), h.tolist()):
        seen[tuple(flat[i : i + n])].add(x)
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_packing(values, counts):
    v = np.array(sorted(values), np.uint64)
    assert (words.unpack_sorted(words.pack_sorted(v)) == v).all()
    assert words.unpack_counts(words.pack_counts(np.array(counts, np.uint64))).tolist() == counts


def test_only_ids_both_ways(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,)], "doc_id long")
    for bound in (0, 10):
        assert [r.text for r in words.only_ids(df, ids, broadcast_rows=bound).collect()] == ["b"]
        assert sorted(r.text for r in words.only_ids(df, ids, how="left_anti", broadcast_rows=bound).collect()) == ["a", "c"]


# -- 1 sharding ------------------------------------------------------------------------------


def check_shards(rows, out, n):
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(n)) and all(r.law == "bytes" and r.grown_shard is None for r in out)
    assert all(sorted(x.slot for x in rs) == list(range(len(rs))) for rs in by.values())
    return [sum(x.size for x in rs) for rs in by.values()]


def test_shards_are_near_equal(spark, docs):
    out = sharding.shard(docs, 10, scratch(spark, "m")).collect()
    sizes = check_shards(pairs(docs), out, 10)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 10


def test_shard_edges(spark, edges):
    check_shards([(d, t) for d, t, _ in EDGES], sharding.shard(edges, 4, scratch(spark, "m")).collect(), 4)
    assert sharding.shard(empty(spark), 4, scratch(spark, "m")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.tuples(st.integers(16, 5000), st.integers(1, 9)), max_size=120), st.integers(1, 6), st.integers(0, 3))
def test_rebalancing_moves_little(of, n, more):
    old = sharding.pack(of, n)
    new = sharding.rebalance(old, of, n + more)
    assert new.keys() == of.keys() and set(new.values()) <= set(range(n + more))
    if not more:
        assert sum(old[s] != new[s] for s in of) <= len(of) // 4 + 2


def test_map_versions(spark):
    path = scratch(spark, "m")
    of = {s: (100, 1) for s in range(100)}
    one = sharding.pack(of, 4)
    sharding.save_map(spark, path, 1, one, of)
    sharding.save_map(spark, path, 2, sharding.rebalance(one, of, 5), of)
    with pytest.raises(Exception):
        sharding.save_map(spark, path, 2, one, of)
    a, b = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    moved = [s for s in a if a[s] != b[s]]
    assert len(moved) == 20 and all(b[s] == 4 for s in moved)


def test_growth(spark, docs):
    rows = sharding.grow(docs, 10, 1, scratch(spark, "m")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.after] += r.size
    assert len(rows) == docs.count() and set(sizes) == set(range(11)) and max(sizes.values()) - min(sizes.values()) < 0.2 * sum(sizes.values()) / 11
    assert sum(r.size for r in rows if r.before != r.after) < 0.2 * sum(sizes.values())


def test_equal_rows_without_id_are_no_hot_slot(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sizes = check_shards([(None, "same")] * 4000, sharding.shard(df, 4, scratch(spark, "m")).collect(), 4)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 4


# -- 2 LM scoring ----------------------------------------------------------------------------


def brute_scores(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, tri, n_docs = Counter(), Counter(), 0
    triples = lambda x: zip([None, None, *x], [None, *x], x)
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            uni.update(x)
            tri.update(triples(x))
            n_docs += 1
    bi = Counter((v, w) for _, v, w in tri)  # continuation counts
    cont = Counter(w for _, w in bi)
    hist = lambda c: tuple(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
    D, E, G = ((0, *kneser_ney.discounts(hist(c))) for c in (bi, cont, tri))
    follow, behind = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])
    for (u, v, _), c in tri.items():
        behind[u, v][min(c, 3)] += 1
        behind[u, v][0] += c
    for (v, _), c in bi.items():
        follow[v][min(c, 3)] += 1
        follow[v][0] += c
    V, N, T = len(uni), sum(uni.values()), len(bi)
    g = sum(E[min(x, 3)] for x in cont.values()) / T if T else 1

    def p2(v, w):
        one = (max(cont[w] - E[min(cont[w], 3)], 0) / T if T else 0) + g / (V + 1)
        k, f = bi[v, w], follow.get(v)
        return (max(k - D[min(k, 3)], 0) + sum(D[j] * f[j] for j in (1, 2, 3)) * one) / f[0] if f else one

    def p(u, v, w):
        k, f = tri[u, v, w], behind.get((u, v))
        return (max(k - G[min(k, 3)], 0) + sum(G[j] * f[j] for j in (1, 2, 3)) * p2(v, w)) / f[0] if f else p2(v, w)

    out = []
    for i, t in rows:
        x = tokens(t)
        out.append((i, held(i), len(x), sum(uni[w] > 0 for w in x), sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in x), sum(math.log10(p(*k)) for k in triples(x))))
    u, v = max(behind, key=lambda k: behind[k][0] if None not in k else 0, default=(None, None))
    total = sum(p(u, v, w) for w in uni) + p(u, v, b"never seen")
    return out, total


def scored(spark, df):
    held = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(df.filter(~held), scratch(spark, "lm"))
    return [tuple(r) for r in kneser_ney.score(df.select("doc_id", "text"), model).select("doc_id", held, "n_tokens", "n_known", "base_score", "score").collect()]


def close(a, b):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[4], 4))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-6, rel=1e-9) and x[5] == pytest.approx(y[5], abs=1e-6, rel=1e-9)


def test_scores(spark, docs):
    want, total = brute_scores(pairs(docs))
    assert total == pytest.approx(1)
    close(scored(spark, docs), want)
    held = [r for r in want if r[1]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)


def test_tables_find_what_was_stored(tmp_path):
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 40, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        values = rng.integers(0, 400, (len(keys), 4)).astype(np.uint64) * (rng.random((len(keys), 4)) < 0.5)
        values[::50] *= np.uint64(1 << 40)
        (tmp_path / str(n)).write_bytes(kneser_ney.table_bytes(keys, values))
        table = kneser_ney.Table(str(tmp_path / str(n)), 4)
        assert (table.find(keys) == values).all() and not table.find(keys ^ np.uint64(1 << 40)).any()


def test_hot_words_are_dealt_by_more_than_themselves(spark):
    """One word is most of the text, so that its pairs are added up in the second step."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join("the" if rng.random() < 0.5 else f"w{rng.integers(0, 30)}" for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, total = brute_scores(rows)
    assert total == pytest.approx(1)
    close(scored(spark, df), want)


def test_score_edges(spark, edges):
    close(scored(spark, edges), brute_scores([(d, t) for d, t, _ in EDGES])[0])
    assert scored(spark, empty(spark)) == []
    only = spark.createDataFrame([(10, "a b", "x")], SCHEMA)  # 10 is held out: nothing to learn from
    assert zlib.crc32(b"10") % 7 != 2 or scored(spark, only)[0][5] == pytest.approx(0)


# -- 3 near-dedup ----------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = split((t or "").encode().lower().decode())
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if 100 * len(a & b) >= percent * len(a | b) and (p := find(i)) != (q := find(j)):
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, ss in sets.items() for s in ss), key=repr)


def components_of(df, n, percent):
    rows = near_dedup.near_duplicates(df, n, percent).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_components(docs):
    assert components_of(docs, 3, 85) == brute_components(pairs(docs), 3, 85)


def test_component_edges(spark, edges):
    assert components_of(edges, 3, 85) == brute_components([(d, t) for d, t, _ in EDGES], 3, 85)
    assert components_of(empty(spark), 3, 85) == []


def brute_first(rows, n, percent):
    """The rows (doc_id, text) that stay, one of each component."""
    best = {}
    for k, size, comp in brute_components([(k, r[1]) for k, r in enumerate(rows)], n, percent):
        i = rows[k][0]
        group = ("set", comp) if size else ("id", i) if i is not None else ("row", k)
        best[group] = min(best.get(group, (True, 0, k)), (i is None, i or 0, k))
    return [rows[k][:2] for _, _, k in best.values()]


def test_first_of_each_component(spark, edges):
    """Rows are judged by their own texts where ids are missing or repeat; copies without ids leave one."""
    other, third = BASE.replace("tok", "other"), " ".join(f"third{i}" for i in range(60))
    # Id 20 has a copy of id -3's text and a text of its own; copies of one text have no ids at all.
    more = [(20, BASE, "i"), (20, other, "i"), (None, third, "j"), (None, third, "k"), (None, third + " end", "l"), (21, None, "m"), (21, "", "m"), (None, "", "n")]
    # Any of the rows that tie may stay.
    tied = lambda rows: sorted(((i, third if t and t.startswith(third) else (t or "").strip()) for i, t in rows), key=repr)
    for rows, df in ((EDGES, edges), (EDGES + more, spark.createDataFrame(EDGES + more, SCHEMA).repartition(3))):
        kept = near_dedup.keep_first(df, 3, 85)
        assert kept.columns == ["doc_id", "text", "slot"]
        assert tied((r.doc_id, r.text) for r in kept.collect()) == tied(brute_first(rows, 3, 85))
    assert near_dedup.keep_first(empty(spark), 3, 85).count() == 0


def test_many_near_copies_of_few_links(spark, monkeypatch):
    """A group whose members mostly aren't linked: several turns of naming, and blocks of it, lose nothing."""
    monkeypatch.setattr(near_dedup, "NAMED", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(90):
        w = [f"t{i}" for i in range(80)]
        for k in rng.choice(80, rng.integers(0, 7), replace=False):
            w[k] = f"r{rng.integers(0, 4)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    assert components_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85) == brute_components(rows, 3, 85)


def test_sketches_never_exclude_a_link():
    rng = np.random.default_rng(5)
    for size in (5, 40, 400, 4000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for drop in range(0, max(1, size // 10)):
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, drop // 3).astype(np.uint64))))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                both, lens = np.concatenate((a, b)), np.array([len(a), len(b)])
                odd = near_dedup.odd_sketches(near_dedup.minhashes(both, words.starts(lens))).view(np.uint64)
                par = near_dedup.parity_sketches(both, lens).view(np.uint64)
                z, y = (int(np.bitwise_count(s[0] ^ s[1]).sum()) for s in (odd, par))
                assert not near_dedup.excluded(z, y, int(lens.sum()), 85)


# -- 4 chat ----------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    t = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    said = {1: t[:2], 2: t, 3: t[:3], 4: t, 5: [("user", "other")], 6: [("user", "hi\nassistant")], 7: [("user", "h"), ("iassistant", "hello")]}
    rows = [(c, i, r, x, "extra") for c, ts in said.items() for i, (r, x) in enumerate(ts)] + [(5, 0, "user", "other", "again"), (None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prefix string")
    out = {r.conv_id: (r.n_turns, r.text) for r in chat.render(df).collect()}
    assert set(out) == {2, 5, 6, 7, None} and out[2][0] == 4
    assert out[5][1] == "<|turn_start|>user\nother<|turn_end|>"
    assert chat.render(df.limit(0)).count() == 0


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, i, "user", f"line {i % 3}") for i in range(9)] + [(1, 0, "user", "line 0"), (2, 0, "user", "x " * 200_000), (2, 1, "assistant", "y " * 200_000)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns, len(r.text) > 1000) for r in out) == [(0, 1, False), (0, 1, False), (1, 1, False), (2, 2, True)]


# -- 5 BPE -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.read_spec(tokenizer_path("word_bpe_49k.json")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abtheIN Σςé́\x1c\x85 't12٣<|endoftext>　日ǅİß\n!?*😀퟿", max_size=40), max_size=5))
def test_ids_are_the_librarys(library, own, texts):
    texts = [*texts, "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>"]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.decode(ids) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids]


def test_bpe_rows(spark, library, docs, edges):
    for df in (docs, edges):
        rows = bpe.encode(df.withColumn("ids", F.lit("clash")), tokenizer_path("word_bpe_49k.json")).collect()
        want = sorted((repr(r.doc_id), hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in df.collect())
        assert sorted((repr(r.doc_id), hashlib.sha256(bytes(r.ids)).hexdigest()) for r in rows) == want
        assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_a_lower_rank_that_a_merge_makes_comes_first(own):
    """Against merging the lowest rank of a word, leftmost first, over and over."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        word = "".join(rng.choice(list("aehinrst"), rng.integers(1, 12)))
        raw = word.encode()
        s = [own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]]
        while True:
            best = min(((own.ranks[k], i) for i, k in enumerate(x << 16 | y for x, y in zip(s, s[1:])) if k in own.ranks), default=None)
            if best is None:
                break
            s[best[1] : best[1] + 2] = [own.pairs[best[0]][2]]
        assert np.frombuffer(own.encode([word])[0], "<u4").tolist() == s


# -- 6 substring dedup -----------------------------------------------------------------------


def brute_kept(rows, n):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {x for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for x in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def kept_of(df, n=13):
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in passages.dedup(df, n).collect()), key=repr)


def test_passages(docs):
    assert kept_of(docs.select("doc_id", "text")) == brute_kept(pairs(docs), 13)


def test_passage_edges(spark, edges):
    assert kept_of(edges) == brute_kept([(d, t) for d, t, _ in EDGES], 13)
    assert passages.dedup(edges).columns == ["doc_id", "text", "slot", "n_words", "removed", "kept"]
    assert kept_of(empty(spark)) == []


def test_passages_keep_columns_of_any_name(spark):
    """Names that the operator uses itself come back with their own values, and no row is lost."""
    names = ["owner", "part", "passage", "kept", "removed", "n_words", "c0", "tie", "windows", "Kept_"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate([BASE, BASE + " end", "", None, "a b " * 9])] + [(None, BASE, *names)]
    df = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = passages.dedup(df)
    assert out.columns == ["doc_id", "text", *names, "n_words_", "removed_", "kept__"] and out.schema[:12] == df.schema[:12]
    got = out.collect()
    assert sorted((tuple(r[:12]) for r in got), key=repr) == sorted(rows, key=repr)
    assert {r.doc_id: r["kept__"] for r in got}[1] == "end"
    assert words.free_names(["a", "B", "b_"], ["b", "a", "c"]) == ["b__", "a_", "c"]


def test_ties_of_a_slice_are_followed_once(spark):
    rows = [(5, 4, 0), (6, 4, 0), (4, 1, 1), (4, 2, 1), (1, 0, 1), (9, 5, 0)]
    df = spark.createDataFrame([(d, None, b, t) for d, b, t in rows], "doc long, windows binary, before long, tie int")
    asked = {(r.doc_id, r.owner) for r in passages.demand(df).collect()}
    assert asked == {(5, 4), (6, 4), (4, 1), (4, 2), (1, 0), (9, 5), (5, 1), (5, 2), (6, 1), (6, 2)}


def test_parts_get_the_passages_that_they_hold(spark):
    """Of an owner with 20 recurring passages, a part gets those that its own documents share."""
    lines = [" ".join(f"line{i}word{j}" for j in range(20)) for i in range(20)]
    rows = [(0, " ".join(lines), 0), *((i + 1, f"own{i} " + t, i + 1) for i, t in enumerate(lines)), (30, "all of this is new " * 2 + " ".join(map(str, range(20))), 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    confirmed = passages.confirm(df, 13, 31)
    assert {r.doc for r in confirmed.filter("windows IS NULL").collect()} == set(range(1, 21))
    got = sorted((r.part, r.owner, bytes(r.passage).decode()) for r in passages.passages(df, confirmed, 13).collect())
    assert got == [(i + 1, 0, t) for i, t in enumerate(lines)]


def test_a_part_reports_once_to_a_range(spark):
    """The number of rows goes by parts and ranges, not by slices of a few MB."""
    texts = [" ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(30)]
    assert sum(map(len, texts)) > 5 << 20
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, part int").coalesce(1)
    assert passages.reports(df, 13, 4).select("shard").count() == 4
    two = df.withColumn("part", F.expr("CAST(doc_id DIV 15 AS INT)")).sort("part").coalesce(1)
    assert passages.reports(two, 13, 4).select("shard").count() == 8


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.sampled_from("a b c d aa".split()), max_size=40).map(" ".join)), min_size=1, max_size=12))
def test_passages_of_few_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_of(df, 4) == brute_kept(rows, 4)


# -- 7 URL filters ---------------------------------------------------------------------------


def test_urls_as_of_their_day(spark):
    import datetime as dt

    day = lambda m, d: dt.date(2024, m, d)
    log = [("bad.com", "block", day(1, 10), 0), ("BAD.com", "remove", day(3, 1), 0), ("bad.com", "block", day(6, 1), 0), ("ok.bad.com", "allow", day(1, 1), 0), ("tie.com", "allow", day(2, 1), 0), ("tie.com", "block", day(2, 1), 1), (None, "block", day(1, 1), 0)]
    entries = spark.createDataFrame(log, url_filters.LIST_SCHEMA)
    caps = [(1, "http://x.bad.com/a", day(1, 9)), (2, "http://x.bad.com:80/a", day(1, 10)), (3, "https://BAD.com", day(2, 29)), (4, "http://bad.com?q", day(3, 1)), (5, "http://bad.com/", day(12, 31)), (6, "http://a.ok.bad.com/", day(2, 1)), (7, "http://notbad.com/", day(2, 1)), (8, None, day(2, 1)), (9, "no host", day(2, 1)), (10, "http://tie.com", day(2, 1)), (11, "http://bad.com", None), (11, "http://bad.com", None)]
    df = spark.createDataFrame([(*c, "x") for c in caps], "page_id long, url string, fetched date, matched string")
    rows = url_filters.evaluate(df, entries).collect()
    assert sorted(r.page_id for r in rows if r.blocked) == [2, 3, 5, 10] and len(rows) == len(caps)
    assert {r.page_id: r.matched for r in rows}[6] == "ok.bad.com"
    assert not any(r.blocked for r in url_filters.evaluate(df, entries.limit(0)).collect())
    assert url_filters.evaluate(df.limit(0), entries).count() == 0


def test_very_long_urls_and_empty_days(spark):
    import datetime as dt

    entries = spark.createDataFrame([("bad.com", "block", dt.date(2024, 1, 1), 0)], url_filters.LIST_SCHEMA)
    rows = [(1, "http://" + "a." * 40 + "bad.com/" + "x" * 300_000, dt.date(2024, 5, 5)), (2, None, None), (3, "http://bad.com", None)]
    got = {r.page_id: r.blocked for r in url_filters.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched date"), entries).collect()}
    assert got == {1: True, 2: False, 3: False}


# -- 8 HTML ----------------------------------------------------------------------------------


def text_of(html, template=()):
    return "\n\n".join(html_text.blocks(html_text.hashed(html_text.parse(html)), set(template)))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple &#65;&nbsp;b &am", "plain & simple A b &am"),
        ("<nav>x</nav><article><h1>T</h1><p><b>One.<br><p>Two  \n three</p></article><footer>f</footer>", "T\n\nOne.\n\nTwo three"),
        ("<body><div class='main-nav'>n</div><p>text<aside>a</aside></p><div id=comments>c</div><form>f</form>", "text"),
        ("<p>a<script>var x='</p>';</script><style>p{}</style>b<!-- <p>no</p> -->c", "abc"),
        ("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", "1\n\n2\n\nx\n\ny"),
        ("<main><section><p>in</section></main><p>out", "in"),
        ("<article><p>1</article><div class=ad>ad</div><article><p>2</article>", "1\n\n2"),
        ("<p>unclosed <a href='>'>link</a", "unclosed link</a"),
        ("<div style='display:none'>no</div><p>yes</p></p></div>", "yes"),
        ("<article><header><h1>Head</h1></header><p>b</p></article>", "Head\n\nb"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(
    "html",
    [
        "<div class='layout with-sidebar'><p>The real text.</p></div>",
        "<p class='lead ad-free'>The real text.</p>",
        "<section id='related-work'><p>The real text.</p></section>",
        "<div id='banner-story'><p>The real text.</p></div>",
        "<div class='ad-container'>Buy.</div><p>The real text.</p><div class='nav-links'>Home</div><div class='comment-list'>Me too.</div><div class='cookie-notice'>We use</div>",
    ],
)
def test_names_of_classes_are_read_by_their_head(html):
    assert text_of(html) == "The real text."


def test_very_long_pages(spark):
    body = "<p>" + "</p><p>".join(f"Paragraph {i} of a long page." for i in range(40_000)) + "</p>"
    rows = [(1, "http://a.com/", f"<nav>n</nav><article>{body}</article>"), (2, "http://a.com/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].count("\n\n") == 39_999 and out[1].endswith("Paragraph 39999 of a long page.") and out[2] == "deep"


def test_templates_go_without_their_names(spark):
    """Recurring subtrees are deleted by their counts alone: the text is the same when tags and classes say nothing."""
    named = "<nav><ul><li>Home</li><li>About</li></ul></nav><article><h1>T %d</h1><p>Body %d.</p></article><footer><p>All rights.</p></footer>"
    plain = named.replace("nav>", "div>").replace("footer>", "div>").replace("article>", "section>")
    for page in (named, plain):
        rows = [(i, "http://a.com/", f"<html><body>{page % (i, i)}</body></html>") for i in range(12)]
        out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert out == {i: f"T {i}\n\nBody {i}." for i in range(12)}


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html as entities

    want = {}
    for r in pages.collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        own = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want[r.page_id] = "\n\n".join(x for x in own if x)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


def test_site_templates_go(spark):
    page = "<html><body><div><div>Site name, menu of all things</div></div><div><p>Content %d is here.</p><p>Shared closing line.</p></div><div>All rights, since %s</div></body></html>"
    rows = [(i, f"http://A.com/{i}", page % (i, "1999")) for i in range(10)] + [(i, f"http://b.com/{i}", page % (i, i)) for i in range(10, 15)] + [(20, None, None), (21, "x", ""), (21, "x", "")]
    rows += [(30 + i, "http://c.com/", "<p>the very same page</p>") for i in range(20)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert "Site name" not in out[3] and "All rights" not in out[3] and out[3].startswith("Content 3 is here.")
    assert out[12].startswith("Site name") and out[20] == out[21] == "" and out[35] == "the very same page"


def test_articles_keep_what_many_share(spark):
    page = "<article><h1>Same head</h1><p>Content %d.</p><p>Shared closing line.</p><div>share this</div></article>"
    rows = [(i, "http://a.com/", page % i) for i in range(10)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {f"Same head\n\nContent {i}.\n\nShared closing line." for i in range(10)}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_subtrees_of_the_whole_page_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "MOST_BROADCAST", most)
    page = "<body><nav><ul><li>Home</li></ul></nav><article>Teaser card</article><div class='ad'>Buy</div><div><p>Content %d.</p></div><footer>Foot %d</footer></body>"
    rows = [(i, "http://a.com/", page % (i, i)) for i in range(10)] + [(20 + i, "http://b.com/", page % (i, i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keyed = df.withColumns({"key": F.col("page_id"), "host": html_text.host_of(F.col("url"))})
    assert html_text.templates(html_text.subtrees(keyed)).count() == 5  # nav, ul, li, article and the div of class ad
    out = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert out == {i: f"Content {i}." for i in range(10)} | {20 + i: "Teaser card" for i in range(3)}


# -- 9 decontamination -----------------------------------------------------------------------

ITEM = "A farmer named John has 12 apples and 30 pears. He gives 12 apples to Mary and 5 kg of flour to Bob. How many apples does John have left now?"


def test_leaks(spark):
    again = ITEM.replace("12", "45").replace("30", "7").replace("John", "Peter").replace("Mary", "Ann").replace("5 kg", "9 lb").replace("Bob", "Tim")
    broken = again.replace("gives 45", "gives 46")  # one number of the item stands for two
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "short item of six words only", 0), (3, None, 0), (4, "", 0), (None, "another benchmark item that has no number but is long enough to be found", 0)], "item_id long, text string, n_covered int")
    filler = "and so it was that the long day ended without any further word from them. "
    rows = [(1, filler + ITEM + " " + filler), (2, filler + again.upper().title()), (3, filler + again), (4, filler + broken[:120]), (5, filler * 20), (6, None), (7, ""), (8, "x short item of six words only."), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"), (10, filler + "«" + ITEM.lower().replace(" ", "  ") + "»%%%"), (None, ITEM), (1, filler + ITEM + " " + filler), (11, filler + "Another benchmark item that has no number but is long enough to be found!")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert {k for k in found if k[0] not in (2, 10)} == {(1, 1), (3, 1), (8, 2), (None, 1), (11, None)}
    assert found[1, 1].verbatim and not found[3, 1].verbatim and found[3, 1].n_changed_slots > 5
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} >= {4, 5, 6, 7, 9} and not {1, 3, 8, 11, None} & {r.doc_id for r in clean.collect()}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0


def leak_of(spark, item, text):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "and so it was that the long day ended. " + text + " And so it was that night.")], "doc_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert (decontaminate.clean(docs, bench).count() == 0) == bool(found)
    return [(r.n_covered, r.n_item_words, r.n_changed_slots, r.verbatim) for r in found]


def test_leaks_that_were_missed(spark):
    """Short questions with other values, names at every beginning, and one edited number in a long copy."""
    assert leak_of(spark, "Maria buys 3 pens for 4 dollars.", "John buys 8 pens for 9 dollars.")
    item = "Tom had 12 marbles. Sue took 4 of them. How many marbles does Tom have left?"
    assert leak_of(spark, item, "Bob had 15 marbles. Ann took 6 of them. How many marbles does Bob have left?")
    long = "At the yearly fair a baker sold 40 loaves before noon and 25 more after lunch, and 40 of the people who came said that they had never seen a baker so glad to see them all"
    assert leak_of(spark, long, long.replace("40 of", "41 of"))


def test_random_new_values_are_found(spark):
    """Of 300 items asked again with other numbers, names and units, nine of ten or more are found, and no other text is."""
    rng = np.random.default_rng(8)
    names, things, verbs = "Tom Ann Raj Mia Leo Eva Sam Zoe".split(), "apples pears books coins cards stamps shells pens".split(), "buys sells finds loses packs paints counts mails".split()
    pick = lambda xs: str(rng.choice(xs))
    forms = [
        lambda n, a, b, c, t, v, u: f"{n[0]} {v} {a} {t} on Monday. {n[1]} {v} {b} more {t} than {n[0]} does. How many {t} do both of them have after {c} days?",
        lambda n, a, b, c, t, v, u: f"A shop {v} {a} boxes with {b} {t} in each of them. If {n[0]} takes {c} {u} away, how many {t} are left in the shop?",
        lambda n, a, b, c, t, v, u: f"In a school of {a} pupils, {n[0]} {v} {b} {t} every week. After {c} weeks, how many {t} has {n[0]} got in all?",
    ]
    items, docs = [], []
    for i in range(300):
        form, t, v = forms[i % 3], pick(things), pick(verbs)
        make = lambda: form(list(rng.choice(names, 2, replace=False)), *rng.choice(np.arange(2, 400), 3, replace=False), t, v, pick(["kg", "lbs", "g"]))  # noqa: E731, B023
        items.append((i, make()))
        docs.append((i, "It was a long day and nobody said a word. " + make() + " And then the rain came down on the town."))
    clean = [(1000 + i, "It was a long day. " + " ".join(pick("the old man went to his house with many bags and 3 dogs".split()) for _ in range(40))) for i in range(100)]
    schema = "{} long, text string"
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs + clean, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id"))).collect()}
    assert sum((i, i) in found for i in range(300)) >= 270 and not any(d >= 1000 for d, _ in found)


def test_leaks_of_long_texts_and_many_copies(spark):
    rows = [(1, LONG + " " + ITEM + " " + LONG)] + [(i, ITEM) for i in range(2, 60)]
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM)], "item_id long, text string")
    got = Counter(r.doc_id for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == {i: 2 for i in range(1, 60)}


def test_leak_of_more_numbers_than_words(spark):
    item = "Compute 48 / 6 + 12 * 3 - 7 and then add 15 to get 46"
    assert leak_of(spark, item, item) == [(13, 13, 0, True)]
    assert leak_of(spark, item, item.replace("48", "49").replace("15", "16")) == []


def test_leak_with_one_value_for_two(spark):
    item = "a shop sold 3 red boxes and 5 green boxes to every one of the customers that came in that day"
    assert leak_of(spark, item, item.replace("3", "4").replace("5", "4")) == [(21, 21, 2, False)]
    both = "a shop sold 3 red boxes and 3 green boxes to every one of the customers that came in"
    assert leak_of(spark, both, both.replace("3", "4", 1)) == []


def test_leak_with_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom gives 2 to Mary. How many apples does Tom have left?"
    assert leak_of(spark, item, item.replace("Tom", "Sam")) == [(16, 16, 3, False)]
    assert leak_of(spark, item, item.replace("Tom", "Sam", 2)) == []  # Tom stands for both
    long = item + " You may count them with the fingers of both of your hands before you give an answer."
    assert leak_of(spark, long, long.replace("Tom", "Sam", 1).replace("Tom", "Sam", 1)) == [(28, 33, 0, True)]  # both beginnings are literal again
    same = "The shop opens early in the morning every day. The shop closes late in the evening every single day."
    assert leak_of(spark, same, same.replace("The", "A", 1)) and leak_of(spark, same, same.replace("The", "A", 1).replace("The", "His"))


def brute_leaks(rows, bench):
    """(doc_id, item_id) of documents that share eight words in a row with an item."""
    index, found = defaultdict(set), set()
    for r in bench.collect():
        w = split(r.text.lower())
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add(r.item_id)
    for i, t in rows:
        w = split((t or "").lower())
        found |= {(i, x) for k in range(len(w) - 7) for x in index.get(tuple(w[k : k + 8]), ())}
    return found


def test_leaks_in_blocks_against_word_windows(spark, sf_dir, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_leaks(pairs(docs), bench)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


# -- 10 quality ------------------------------------------------------------------------------


def brute_measures(text):
    t = text or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {x for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def brute_verdict(text):
    """Whether the current policy keeps a text."""
    n, chars, symbols, _, again = brute_measures(text)
    upper, lower = (sum(a <= c <= z for c in text or "") for a, z in ("AZ", "az"))
    return not (n < 10 or 100 * again > 20 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 20 * n or upper > lower)


def test_ledger(spark, docs, edges):
    for df in (docs, edges):
        led = quality.ledger(df)
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect()), key=repr)
        assert got == sorted(((d, *brute_measures(t)) for d, t in pairs(df)), key=repr)
    verdicts = quality.apply_policy(quality.ledger(docs)).collect()
    assert all(not (r.base_failed and r.kept) for r in verdicts)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdicts if r.kept)
    assert quality.ledger(empty(spark)).count() == 0 and quality.keep_good(edges).columns == edges.columns


def test_stored_ledgers(spark, docs):
    path = scratch(spark, "ledger")
    led = quality.save_ledger(quality.ledger(docs), path)
    with pytest.raises(Exception):
        quality.save_ledger(led, path)
    again = quality.open_ledger(spark, path)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, quality.ledger(docs).collect()))
    masks = [r.fail_mask for r in again.collect()]
    for r in quality.policies(again).collect():
        assert (r.n_kept, r.n_rejected) == (sum(not m & r.mask for m in masks), sum(bool(m & r.mask) for m in masks))
    named = docs.withColumns({"key_a": F.lit("mine"), "KEY_B": F.lit(1)})
    kept = quality.keep_good(named)
    assert kept.columns == named.columns and kept.filter("key_a = 'mine'").count() == sum(r.kept for r in quality.apply_policy(led).collect())


def test_ablations(docs):
    led = quality.ledger(docs)
    masks = [r.fail_mask & quality.CURRENT.mask for r in led.collect()]
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(led).collect()}
    bits = {name: 1 << k for k, (name, _) in enumerate(quality.RULES) if quality.CURRENT.mask >> k & 1}
    assert got == {name: (sum(bool(m & b) for m in masks), sum(m == b for m in masks)) for name, b in bits.items()}


def test_good_documents_stay(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.apply_policy(quality.ledger(docs)).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) == len(good) and sum(bad) <= 0.1 * len(bad)
