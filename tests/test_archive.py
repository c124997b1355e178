"""Archives: blank lines, short blocks, appends, lookups, pruning that never loses a line."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shalebed.operators import index, search
from shalebed.options import ArchiveOptions, level, preset
from shalebed.plans import exchanges, pushed, python_nodes
from shalebed.sources import archive
from shalebed.sources.lines import lines_of, read_lines
from shalebed.storage import scratch

TEXT = [
    "2024-01-02T03:04:05Z ERROR connection refused by 10.0.0.1",
    "",
    "INFO database Ready\r",
    "warn: authentication_failed for user=ann; retry",
    "élan vital, naïve café ABCDEF",
    "x",
    "if (a < b) { return; } />",
    "",
]


def frame(spark, texts, block):
    return spark.createDataFrame([(i, i // block, t) for i, t in enumerate(texts)], "line_no long, block_id long, line string")


@pytest.fixture(scope="module")
def built(spark):
    path = scratch(spark, "t")
    archive.write(frame(spark, TEXT * 30, 50), path, ArchiveOptions(block_size=50))
    return archive.Archive(spark, path)


TERMS = ["", "x", "if", "/>", "ERROR", "error", "connection refused", "base Rea", "é", "café", "d by 10.0", "zzz", "nothing like this " * 20, "cation_fail", "\r"]


@pytest.mark.parametrize("term", TERMS)
def test_search_is_a_full_scan(built, term):
    want = [i for i, t in enumerate(TEXT * 30) if term in t]
    assert sorted(r.line_no for r in built.search(term).collect()) == want
    assert built.count(term).first()[0] == len(want)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_index_only_skips_blocks_that_cannot_match(built, data):
    line = data.draw(st.sampled_from(TEXT))
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(line)), st.integers(0, len(line)))))
    term = line[a:b]
    kept = {r[0] for r in search.candidates(built.blocks, term).collect()}
    assert {i // 50 for i, t in enumerate(TEXT * 30) if term in t} <= kept


def test_every_short_block_is_indexed(spark):
    for n in (1, 99, 101):
        lines = frame(spark, [f"needle{i}" for i in range(n)], 100)
        assert {r[0] for r in search.candidates(index.blocks_of(lines), f"needle{n - 1}").collect()} >= {(n - 1) // 100}


def test_rows_and_blank_lines(built):
    assert built.get_row(1).first().line == ""
    assert built.get_row(239).first().line == ""
    assert built.get_row(240).count() == 0
    assert [r.line for r in built.reconstruct().collect()] == TEXT * 30
    assert built.stats().first().row_count == 240
    assert search.block_scan(built.lines, 4).count() == 40


def test_append_keeps_numbers_and_index(spark):
    path = scratch(spark, "t")
    a = archive.write(frame(spark, TEXT, 5), path, ArchiveOptions(block_size=5))
    a.append(frame(spark, ["a new needle", ""], 5))
    assert [r.line for r in a.reconstruct().collect()] == [*TEXT, "a new needle", ""]
    assert a.search("needle").first().line_no == len(TEXT)
    assert [r.block_id for r in a.blocks.orderBy("block_id").collect()] == [0, 1, 2]
    assert a.get_row(9).count() in (0, 1) and search.get_rows(a.lines, 9, 9).first().line == ""


def test_vectors_are_attached_once_and_for_all(spark):
    a = archive.write(frame(spark, TEXT, 5), scratch(spark, "t"), ArchiveOptions(block_size=5))
    assert a.sketches is None
    with pytest.raises(ValueError):
        a.attach(spark.createDataFrame([(0, [1.0])], "block_id long, v array<double>"))
    a.attach(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "block_id long, v array<double>"))
    with pytest.raises(ValueError):
        a.attach(a.sketches)


def test_lookup_reads_what_it_needs(built):
    plan = built.get_row(7)
    assert any("line_no" in f for f in pushed(plan)) and any("block_id" in f for f in pushed(plan))
    assert exchanges(plan) == 0 and not python_nodes(built.search("connection"))
    assert any("StringContains" in f for f in pushed(built.search("connection")))


def test_files_are_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo")
    (tmp_path / "sub" / "b.log").write_bytes(b"three\n")
    (tmp_path / "c.log").write_bytes(b"")
    got = read_lines(spark, str(tmp_path), 2, recursive=True).orderBy("line_no").collect()
    assert [(r.line_no, r.block_id, r.line) for r in got] == [(0, 0, "one\r"), (1, 0, ""), (2, 1, "two"), (3, 1, "three")]
    assert archive.kind_of(spark, str(tmp_path)) == "plain"


def test_lines_of_texts(spark):
    docs = spark.createDataFrame([(5, "a\n\nb\n"), (9_000_000, "c"), (7, ""), (8, None), (6, "\n")], "doc_id long, text string")
    got = lines_of(docs, 2).orderBy("line_no").collect()
    assert [(r.doc_id, r.line_no, r.block_id, r.line) for r in got] == [(5, 0, 0, "a"), (5, 1, 0, ""), (5, 2, 1, "b"), (6, 3, 1, ""), (7, 4, 2, ""), (9_000_000, 5, 2, "c")]


def test_many_candidates_are_a_semi_join(spark, monkeypatch):
    monkeypatch.setattr(search, "LISTED", 1)
    lines = frame(spark, ["needle"] * 10, 2)
    assert search.search(lines, index.blocks_of(lines), "needle").count() == 10


def test_searches_ask_the_index_at_every_size(spark):
    lines = [f"row {i}" for i in range(400)]
    lines[123] = "a needle here"
    a = archive.write(frame(spark, lines, 10), scratch(spark, "t"), ArchiveOptions(block_size=10))
    hit, none = a.search("needle"), a.search("zzqzz")
    assert any(f == "EqualTo(block_id,12)" or "block_id,12" in f or "In(block_id, [12])" in f for f in pushed(hit))
    assert [r.line_no for r in hit.collect()] == [123]
    assert none.count() == 0 and not pushed(none)  # no candidates: nothing is scanned


def test_unfinished_batches_are_not_seen(spark):
    """A writer that fails before its commit leaves lines that no reader sees and the next writer replaces."""
    path = scratch(spark, "t")
    a = archive.write(frame(spark, TEXT, 5), path, ArchiveOptions(block_size=5))
    frame(spark, ["lost"], 5).write.parquet(f"{path}/lines/batch=1")
    assert archive.Archive(spark, path).lines.count() == len(TEXT)
    a.append(frame(spark, ["kept"], 5))
    again = archive.Archive(spark, path)
    assert again.search("lost").count() == 0 and again.search("kept").first().line_no == len(TEXT)
    assert again.get_row(len(TEXT)).first().line == "kept" and again.get_row(len(TEXT) + 1).count() == 0


def test_repeated_and_null_keys_keep_their_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "c"), (None, "d"), (1, "c"), (None, "e\nf"), (1 << 60, "g")], "doc_id long, text string")
    got = lines_of(docs, 2).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(8)) and sorted(r.line for r in got) == list("abccdefg")
    assert {(r.doc_id, r.pos, r.line) for r in got} >= {(1, 0, "a"), (1, 1, "b"), (None, 0, "e"), (None, 1, "f"), (1 << 60, 0, "g")}
    assert got[-1].line == "g" and [r.block_id for r in got] == [i // 2 for i in range(8)]
    assert lines_of(docs.limit(0), 2).count() == 0


def test_options_of_archives_are_kept(spark):
    lines = frame(spark, [f"user {i} failed from 10.0.0.{i % 9}" for i in range(40)], 10)
    a = archive.write(lines, scratch(spark, "t"), ArchiveOptions(block_size=10, trigrams=False, templates=True, sketches=True, sketch_dim=16))
    assert a.search("user 7 ").count() == 1 and a.blocks.filter("tri_u IS NOT NULL").count() == 0
    assert spark.read.parquet(f"{a.path}/templates").count() == 4
    assert a.vector_report().first().asDict() == {"dim": 16, "bits": 4, "n_blocks": 4}


def test_similar_blocks(spark):
    import numpy as np

    a = archive.write(frame(spark, [f"line {i}" for i in range(60)], 10), scratch(spark, "t"), ArchiveOptions(block_size=10))
    assert a.similar([1.0] * 64, k=3).count() == 0 and a.vector_report().count() == 0
    v = np.random.default_rng(4).normal(size=(6, 64))
    a.attach(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "block_id long, embedding array<double>"))
    for i in (0, 5):
        best = a.similar(v[i], k=2).collect()
        assert best[0].block_id == i and best[0].score > 0.97 and len(best) == 2
        assert [r.block_id for r in a.similar(v[i], threshold=0.9).collect()] == [i]
    assert a.similar_lines(v[3], k=1).first().lines == [f"line {i}" for i in range(30, 40)]
    assert a.sketch(2).count() == 1 and a.similar([0.0] * 64, k=2).count() == 0
    with pytest.raises(IndexError):
        a.sketch(6)


def test_payloads_of_blocks(spark, built):
    import zstandard

    got = {r.block_id: r for r in built.payloads().collect()}
    assert len(got) == 5
    texts = TEXT * 30
    for i, r in got.items():
        data = zstandard.decompress(bytes(r.payload))
        assert data.decode() == "".join(t + "\n" for t in texts[50 * i : 50 * i + 50]) and len(data) == r.raw_bytes


def test_limited_search_says_how_many_more(built):
    assert tuple(built.limited("connection", 7).first()) == (7, 23) and tuple(built.limited("zzqzz", 7).first()) == (0, 0)


def test_options():
    assert level(3).codec_level == 3 and not level(3).dictionary
    assert level(9).codec_level == 9 and level(22).dictionary_bytes == 1024 * 1024 and level(99).codec_level == 22
    assert not preset("adaptive").with_(transform="dna_2bit").auto_transform
    assert preset("archival").writer()["parquet.compression.codec.zstd.level"] == "9"
