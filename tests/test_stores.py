"""Stored chunk archives and raw archives against plain Python, and the dispatch on what a folder holds."""

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shalebed.operators import detection, genome, index, vectors
from shalebed.options import detected, preset
from shalebed.sources import archive, chunk_store, dispatch, raw
from shalebed.storage import scratch

DATA = bytes((7 * i + 13) % 256 for i in range(1000))


def frame(spark, rows):
    return spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "file string, content binary")


def contents(a):
    return {r.file: bytes(r.content) for r in a.read().collect()}


def test_chunk_archive_against_slices(spark):
    a = chunk_store.write(frame(spark, [("f", DATA), ("same", b"z" * 500), ("empty", b""), ("none", None)]), scratch(spark, "c"), size=64)
    want = {"f": DATA, "same": b"z" * 500, "empty": b"", "none": b""}
    assert contents(a) == want and tuple(a.stats().first()) == (4, 24, 1500)
    for start, length in ((0, 1), (60, 10), (0, 1000), (990, 50), (2000, 5), (0, 0)):
        got = {r.file: bytes(r.content) for r in a.range(start, length).collect()}
        assert got == {n: b[start : start + length] for n, b in want.items() if b[start : start + length]}
    assert {r.file: (r.chunk_id, r.within) for r in a.chunk_for(200).collect()} == {"f": (3, 8), "same": (3, 8)}
    a.append(frame(spark, [("f", b"q" * 100), ("new", b"n" * 70), ("empty", b"x")]))
    want |= {"f": DATA + b"q" * 100, "new": b"n" * 70, "empty": b"x"}
    assert contents(a) == want
    a.patch(spark.createDataFrame([("f", 3, bytearray(b"!" * 100)), ("new", 1, bytearray(b""))], "file string, chunk_id long, payload binary"))
    want |= {"f": want["f"][:192] + b"!" * 100 + want["f"][256:], "new": b"n" * 64}
    assert contents(chunk_store.ChunkArchive(spark, a.path)) == want
    assert {r.file: bytes(r.content) for r in a.range(150, 300).collect()}["f"] == want["f"][150:450]
    assert contents(a).keys() == want.keys() and [r.file for r in a.read(["new"]).collect()] == ["new"]
    with pytest.raises(IndexError):
        a.patch(spark.createDataFrame([("f", 99, bytearray(b"!"))], "file string, chunk_id long, payload binary"))


@settings(max_examples=2, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=4, max_size=4), st.lists(st.binary(max_size=200), min_size=4, max_size=4))
def test_appends_are_concatenation(spark, first, second):
    a = chunk_store.write(frame(spark, [(str(i), b) for i, b in enumerate(first)]), scratch(spark, "c"), size=32)
    a.append(frame(spark, [(str(i), b) for i, b in enumerate(second)]))
    assert contents(a) == {str(i): x + y for i, (x, y) in enumerate(zip(first, second, strict=True))}


PAYLOADS = [("a.fa", b">h\nACGTNacgt\n" * 90), ("b.csv", b"1,2,3\n" * 300), ("c.bin", bytes(range(256)) * 40), ("d.txt", b"words and words " * 99), ("e", b""), ("f", bytes((i * i * 7919 >> 3) % 256 for i in range(900)))]


@pytest.mark.parametrize("name", ["adaptive", "dna", "numeric", "binary", "nibble_split", "structured", "realtime"])
def test_raw_archives_come_back(spark, name):
    files = frame(spark, PAYLOADS).withColumnRenamed("file", "file_name")
    a = raw.write(files, scratch(spark, "r"), preset(name))
    assert {r.file_name: bytes(r.content) for r in a.read().collect()} == dict(PAYLOADS)
    rows = {r.file_name: r for r in a.rows.collect()}
    if name == "adaptive":
        assert rows["a.fa"].transform == "dna_2bit" and rows["b.csv"].transform == "numeric_delta" and len({r.level for r in rows.values()}) > 1
    for r in a.sizes().collect():
        assert r.stored == (r.compressed_size == len(dict(PAYLOADS)[r.file_name]) and rows[r.file_name].transform == "none" and r.stored)
    with pytest.raises(ValueError):
        archive.Archive(spark, a.path).meta


def test_folders_are_opened_by_their_kind(spark, tmp_path):
    lines = spark.createDataFrame([(0, 0, "one"), (1, 0, "two")], "line_no long, block_id long, line string")
    one = archive.write(lines, scratch(spark, "a")).path
    two = chunk_store.write(frame(spark, [("f", DATA)]), scratch(spark, "c")).path
    three = raw.write(frame(spark, [("f", DATA)]).withColumnRenamed("file", "file_name"), scratch(spark, "r")).path
    assert [type(dispatch.open_archive(spark, p)).__name__ for p in (one, two, three)] == ["Archive", "ChunkArchive", "RawArchive"]
    (tmp_path / "x.log").write_bytes(b"one\ntwo\n")
    with pytest.raises(ValueError):
        dispatch.open_archive(spark, str(tmp_path))
    for p in (one, str(tmp_path)):
        assert [r.line for r in dispatch.lines_at(spark, p).orderBy("line_no").collect()] == ["one", "two"]
        assert [bytes(r.content) for r in dispatch.payloads_at(spark, p).collect()] == [b"one\ntwo\n"]
    for p in (two, three):
        assert [bytes(r.content) for r in dispatch.payloads_at(spark, p).collect()] == [DATA]


def test_words_of_blocks(spark):
    lines = spark.createDataFrame([(0, 0, "alpha beta"), (1, 1, "beta gamma_1"), (2, 2, "alphabet")], "line_no long, block_id long, line string")
    path = scratch(spark, "w")
    index.write_words(lines, path)
    asked = lambda *w: sorted(r[0] for r in index.word_candidates(spark, path, list(w)).collect())
    assert asked("beta") == [0, 1] and asked("beta", "alpha") == [0] and asked("alpha") == [0] and asked("Alpha") == [] and asked("gamma_1") == [1]


def test_similarity_index_in_memory(spark):
    import numpy as np

    v = np.random.default_rng(9).normal(size=(8, 32))
    rows = lambda a, b: spark.createDataFrame([(i, v[i].tolist()) for i in range(a, b)], "block_id long, embedding array<double>")
    own = vectors.SimilarityIndex(spark)
    assert own.query_top(v[0], 2).count() == 0 and own.count() == 0
    own.add(rows(0, 5)).add(rows(5, 8))
    assert own.count() == 8 and own.query_top(v[6], 1).first().block_id == 6 and [r.block_id for r in own.query(v[2], 0.9).collect()] == [2]
    with pytest.raises(Exception, match="lengths"):
        vectors.project(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "block_id long, embedding array<double>").coalesce(1), 16, "block_id").collect()


def test_saved_kmers(spark):
    path = scratch(spark, "k")
    rows = spark.createDataFrame([(1, "ACGTT" * 20), (2, "TTTTTGGGGGCCCCCAAAAATTTTT")], "doc_id long, bases string")
    genome.save_index(genome.kmer_index(rows, "bases", "doc_id"), path)
    assert [(r.doc_id, r.pos) for r in genome.lookup(genome.open_index(spark, path), "TTTTTGGGGGCCCCCAAAAAT").collect()] == [(2, 0)]
    assert spark.read.parquet(f"{path}/meta").first().k == genome.K


def test_detection_makes_options(spark):
    row = detection.smart_detect(frame(spark, [("x", b"12,34\n" * 9000)]), "content").first()
    o = detected(row.transform, row.level, row.dictionary_bytes)
    assert (o.transform, o.codec_level, o.trigrams, o.dictionary) == ("numeric_delta", 3, True, row.dictionary_bytes > 0)
    said = detection.analyze(frame(spark, [("x.fasta", b"hello you"), ("y", b"hello you")]), "content", "file").orderBy("file").collect()
    assert [(r.kind, r.reason) for r in said] == [("Dna", "by its name"), ("Text", "mostly printable")]


def test_times_are_utc_in_every_zone(spark):
    from shalebed.operators import templates

    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-01 00:00:00",), ("240301 000000",)], "t string")
        assert [r[0] for r in df.select(templates.parse_timestamp_ms(F.col("t"))).collect()] == [1709251200000] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_stored_ratios_are_of_real_frames(spark):
    from shalebed import catalog

    got = catalog.queries()["zstd_ratio"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in catalog.documents(spark, "/root/testdata/sf0.001").collect()}
    for r in got:
        n = len(texts[r.doc_id])
        assert r.size in (n, None) and (not n or abs(r.ratio - len(zstandard.ZstdCompressor(level=3).compress(texts[r.doc_id])) / n) < 1e-5)
