"""Templates, transforms, vectors, chunks and detection against plain Python."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shalebed.functions import bytes as B
from shalebed.functions import codec
from shalebed.operators import chunks, detection, genome, templates, transforms, vectors
from shalebed.sources import files
from shalebed.storage import scratch

VARIABLES = {
    "took 12 of 345": ["Integer", "Integer"],
    "from 192.168.1.10 to": ["IpAddress"],
    "id 550e8400-e29b-41d4-a716-446655440000.": ["Uuid"],
    "at 0xDEADbeef now": ["Hex"],
    "sum deadbeef01 ok": ["Hex"],
    "open /var/log/x.log": ["Path"],
    "v 3.14 and 1e9": ["Float", "Float"],
    "t -5 a-5": ["Integer", "Integer"],
    "nothing here": [],
    "081109 203615 148": ["Timestamp", "Integer"],
    "2024-02-29 23:59:59 x": ["Timestamp"],
    "123ms": [],
    "server1": ["Integer"],
    "C:\\Users\\ann": ["Path"],
    "1.2.3.4.5": ["Float", "Float", "Integer"],
}


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()[0]


def test_variables(spark):
    rows = spark.createDataFrame([(k,) for k in VARIABLES], "line string").select("line", templates.variables(F.col("line")).alias("v"), templates.values_of(F.col("line")).alias("java")).collect()
    for r in rows:
        assert [x.type for x in r.v] == VARIABLES[r.line], r.line
        assert [x.value for x in r.v] == r.java == [r.line[x.start : x.end] for x in r.v]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("0123456789abcdefxXE.-/: \\_", max_size=40), min_size=30, max_size=30))
def test_java_and_python_see_the_same(spark, lines):
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", templates.values_of(F.col("line")).alias("v")).collect()
    for r in rows:
        assert r.v == ([m[0] for m in templates.NAMED.finditer(r.line)] if len(templates.NAMED.findall(r.line)) <= 16 else [])


def test_lines_without_a_hint_have_no_variable():
    for text in (*VARIABLES, "deadbeef", "x deadbeefa y", "C:\\abc", "/abc", "plain words only"):
        assert re.search(templates.HINT, text) or not templates.NAMED.search(text)


def test_templates_rebuild(spark):
    lines = [*VARIABLES, "has <*> itself 5", "", " ".join(map(str, range(20)))]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    back = templates.decoded(templates.encoded(df).drop("line")).orderBy("line_no").collect()
    assert [r.line for r in back] == lines


@pytest.mark.parametrize(("text", "ms"), [("240229 000000", 1709164800000), ("2024-03-01 00:00:00", 1709251200000), ("700101 000000", 0), ("991231 235959", 946684799000), ("1703548800", 1703548800000), ("1703548800123", 1703548800123), ("2100-01-01 00:00:00", 4102444800000), ("12345", None), ("x", None), ("2024-13-01 00:00:00", None)])
def test_times(spark, text, ms):
    assert one(spark, templates.parse_timestamp_ms(F.col("t")), t=text) == ms


payload = st.one_of(st.binary(max_size=300), st.integers(0, 200).map(lambda n: bytes(i % 256 for i in range(n))), st.lists(st.integers(0, 4000), max_size=80).map(lambda v: np.array(v, "<u2").tobytes()))


@settings(max_examples=200, deadline=None)
@given(payload)
def test_byte_transforms_come_back(data):
    for there, back in ((transforms.binary_delta_bytes, transforms.binary_undelta_bytes), (transforms.nibble_split_bytes, transforms.nibble_join_bytes), (transforms.numeric_delta_bytes, transforms.numeric_undelta_bytes), (genome.encode_fasta_bytes, genome.decode_fasta_bytes)):
        assert back(there(data)) == data


@settings(max_examples=100, deadline=None)
@given(st.text("ACGTNacgtnRYK>; x\n\r", max_size=200))
def test_fasta_comes_back(text):
    assert genome.decode_fasta_bytes(genome.encode_fasta_bytes(text.encode())) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=300), st.text("ACGTN", max_size=50), st.integers(0, 250))
def test_reference_encoding_comes_back(base, noise, at):
    reference = base.encode() * 2
    sample = reference[at : at + 90] + noise.encode() + reference[:70]
    ref = genome.Reference(reference)
    segments = [{"op": o, "ref_pos": p, "length": n, "bases": x} for o, p, n, x in ref.encode(sample)]
    assert ref.decode(segments) == sample
    assert all(s["length"] >= genome.LEAST for s in segments if s["op"] == "match")


def test_zigzag(spark):
    values = [0, 1, -1, 2**40, -(2**40)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(transforms.zigzag(F.col("v")).alias("z"), transforms.unzigzag(transforms.zigzag(F.col("v"))).alias("b")).collect()
    assert [r.z for r in df] == [0, 2, 1, 2**41, 2**41 - 1] and [r.b for r in df] == values


def test_time_widths(spark):
    ms = [0, 50, 50, 30_000, 200_000, 100, 5_000_000_000, 4_999_999_999]
    df = transforms.timestamp_deltas(spark.createDataFrame([(1, i, t) for i, t in enumerate(ms)], "s int, i int, t long"), "t", "s", ["i"])
    assert [r.width for r in df.orderBy("i").collect()] == [9, 1, 3, 3, 5, 5, 9, 5]


@pytest.mark.parametrize("dim", [16, 64, 128, 256])
@pytest.mark.parametrize("bits", [2, 4])
def test_quantised_sketches(dim, bits):
    v = np.vstack([np.random.default_rng(dim).normal(size=(20, dim)), np.zeros((1, dim))])
    norms, codes = vectors.quantize_array(v, bits)
    assert (vectors.unpack(vectors.pack(codes, bits), bits) == codes).all()
    assert len(vectors.pack(codes, bits)[0]) == dim * bits // 8
    back = vectors.dequantize_array(norms, codes, bits)
    cos = (back[:20] * v[:20]).sum(axis=1) / np.linalg.norm(back[:20], axis=1) / np.linalg.norm(v[:20], axis=1)
    assert cos.min() > (0.97 if bits == 4 else 0.8)
    assert np.allclose(vectors.rotation(dim) @ vectors.rotation(dim).T, np.eye(dim))


def test_vector_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id long, embedding array<float>")
    assert [(r.id, round(r.score, 4)) for r in vectors.above(df, [2.0, 0.0], 0.5, "id").collect()] == [(0, 1.0), (2, 0.7071), (4, 0.7071)]
    assert [r.id for r in vectors.top(df, [1.0, 1.0], 3, "id").collect()] == [2, 4, 0]
    assert vectors.top(df, [0.0, 0.0], 3, "id").count() == vectors.top(df, [], 3, "id").count() == 0
    with pytest.raises(ValueError):
        vectors.checked_dim(48)


def test_projection_keeps_lengths(spark):
    v = np.random.default_rng(1).normal(size=(30, 128))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = np.array([r.projected for r in vectors.project(df, 64, "id").orderBy("id").collect()])
    assert np.allclose(got, vectors.project_array(v, 64)) and abs(np.linalg.norm(got, axis=1).mean() / np.linalg.norm(v, axis=1).mean() - 1) < 0.2
    terms = spark.createDataFrame([(0, 3, 2.0), (0, 5, 1.0), (1, 3, 2.0), (1, 5, 0.9)], "id long, term_id int, weight double")
    a, b = (np.array(r.projected) for r in vectors.project_sparse(terms, 16, "id", 10).orderBy("id").collect())
    assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.95


def test_detection(spark):
    cases = {b"ACGTACGTNN\n" * 60: "Dna", b"12,34.5,-6\n" * 60: "Numeric", b"The quick brown fox jumps. " * 30: "Text", bytes(range(200, 256)) * 20: "StructuredBinary", bytes(range(128)) * 20: "Binary", b"": "Binary"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "data binary")
    got = df.select("data", B.histogram(F.col("data")).alias("h")).select("data", detection.detect(F.col("h")).alias("k")).collect()
    assert {bytes(r.data): r.k for r in got} == cases
    names = spark.createDataFrame([("a.FASTA",), ("t.csv",), ("b.xlsx",), ("my_genome.txt",), ("c.txt",)], "n string")
    assert [r[0] for r in names.select(detection.by_name(F.col("n"))).collect()] == ["Dna", "Numeric", "StructuredBinary", "Dna", None]
    smart = detection.smart_detect(spark.createDataFrame([(bytearray(b"x" * n),) for n in (0, 256, 300, 40_000)], "data binary"), "data").collect()
    assert [(r.size, r.kind, r.level, r.dictionary_bytes) for r in smart] == [(0, "Text", 1, 0), (256, "Text", 1, 0), (300, "Text", 1, 0), (40_000, "Text", 6, 16_384)]


def test_lz_and_levels(spark):
    def lz(b):
        return one(spark, B.lz_match_ratio(F.col("d")), d=bytearray(b))

    assert lz(b"abc") == 0.0 and lz(bytes(range(250))) == 0.0 and lz(b"abcdefgh" * 100) > 0.9
    assert one(spark, B.recommended_level(B.compressibility(F.col("e"), F.col("l"))), e=0.0, l=0.9) == 1
    counts = spark.createDataFrame([(bytearray(b"aabb"),)], "d binary").select(B.histogram(F.col("d")).alias("h"))
    assert math.isclose(counts.select(B.entropy(F.col("h"))).first()[0], 1.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"abcd", b"ab", b"x", b"abcdabcdabcd", b"\x00" * 9, bytes(range(40))]), max_size=40).map(b"".join))
def test_repeats_against_a_plain_walk(b):
    seen, total, at = {}, 0, 0
    while at + 4 <= len(b):
        old = seen.get(b[at : at + 4])
        if old is not None and old + 4 <= at:
            n = 0
            while n < min(256, len(b) - at, at - old) and b[old + n] == b[at + n]:
                n += 1
            total, at = total + n, at + n
        else:
            seen[b[at : at + 4]] = at
            at += 1
    assert B.repeated_bytes(b) == total


def test_scores_of_many_values_are_those_of_each():
    values = [b"", b"a", b"aaaa", bytes(range(256)) * 3, b"hello you", bytes(np.random.default_rng(1).integers(0, 256, 4096, np.uint8))]
    for depths in (B.COMPARED, B.DEPTHS):
        assert np.allclose(B.resultants(values, depths), np.vstack([B.resultants([v], depths) for v in values]))
    assert (B.resultants(values[:3], (3,))[:, 0] == [0, 1, 1]).all()


def test_chunks_against_slices(spark):
    data = bytes((7 * i + 13) % 256 for i in range(1000))
    df = spark.createDataFrame([("f", bytearray(data)), ("empty", bytearray())], "n string, d binary")
    cut = chunks.chunks_of(df, "n", "d", 64)
    assert cut.count() == 16
    for start, length in ((0, 1), (60, 10), (0, 1000), (990, 50), (100, 500), (2000, 5), (0, 0)):
        got = [bytes(r.content) for r in chunks.byte_range(cut, start, length).collect()]
        assert got == ([data[start : start + length]] if data[start : start + length] else [])
    more = spark.createDataFrame([("f", bytearray(b"z" * 100)), ("new", bytearray(b"q"))], "file string, content binary")
    assert {r.file: bytes(r.content) for r in chunks.joined(chunks.appended(cut, more, 64)).collect()} == {"f": data + b"z" * 100, "new": b"q"}
    longer = chunks.patched(cut, spark.createDataFrame([("f", 3, bytearray(b"!" * 100))], "file string, chunk_id long, payload binary"))
    whole = data[:192] + b"!" * 100 + data[256:]
    assert bytes(chunks.joined(longer).first().content) == whole
    assert bytes(chunks.byte_range(longer, 150, 300).first().content) == whole[150:450]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=60), st.binary(max_size=60)), min_size=8, max_size=8))
def test_delta_and_apply(spark, pairs):
    pairs = [*pairs, (b"a" * 64, b"a" * 32), (b"a" * 64, b"a" * 40), (b"", b"x"), (b"x", b""), (b"same" * 9, b"same" * 9)]
    old, new = (spark.createDataFrame([(i, bytearray(p[k])) for i, p in enumerate(pairs)], "n int, d binary") for k in (0, 1))
    patches = chunks.delta(old, new, "n", "d", 16)
    sizes = new.select(F.col("n").alias("file"), F.octet_length("d").cast("long").alias("new_size"))
    got = {r.file: bytes(r.content) for r in chunks.apply_delta(old, patches, sizes, "n", "d", 16).collect()}
    assert got == {i: p[1] for i, p in enumerate(pairs)}


def test_packs_of_files(spark):
    rows = [("a/x.txt", bytearray(b"hello " * 200)), ("b/x.txt", bytearray(b"")), ("c.bin", bytearray(range(256)))]
    path = scratch(spark, "pack")
    files.pack(spark.createDataFrame(rows, "file_name string, content binary"), path)
    assert {r.file_name: bytes(r.content) for r in files.extract(spark, path).collect()} == {n: bytes(c) for n, c in rows}
    assert [r.file_name for r in files.extract(spark, path, ["c.bin"]).collect()] == ["c.bin"]
    listed = {r.file_name: r for r in files.listing(spark, path).collect()}
    assert listed[None].original_size == 1456 and listed["a/x.txt"].ratio < 0.2
    with pytest.raises(Exception, match="outside the archive"):
        files.checked(spark.createDataFrame([("../x",)], "file_name string")).collect()


def test_codec(spark):
    rows = spark.createDataFrame([(bytearray(b"some log line %d " % i * 20),) for i in range(200)], "d binary")
    dictionary = codec.train_dictionary(rows, "d", 2048)
    back = rows.select("d", codec.decompressed(codec.compressed(F.col("d"), 3, dictionary), dictionary).alias("b")).collect()
    assert all(r.d == r.b for r in back)
    assert codec.train_dictionary(rows.limit(0), "d") == b""


def test_runs(spark):
    text = "ABcD" + "e" * 5 + "F"
    bits = re.sub("[^1]", "0", re.sub("[A-Z]", "1", text))
    assert one(spark, transforms.unruns(transforms.runs(F.col("t"), "A-Z")), t=text) == bits
    got = genome.letter_runs(spark.createDataFrame([(1, text)], "i int, t string"), "t", "A-Z", "i").orderBy("start").collect()
    assert [(r.start, r.length) for r in got] == [(0, 2), (3, 1), (9, 1)]
    points = spark.createDataFrame([(1, p) for p in range(10)], "i int, pos int")
    runs = genome.letter_runs(spark.createDataFrame([(1, text)], "i int, t string"), "t", "A-Z", "i")
    assert sorted(r.pos for r in genome.in_runs(points, runs, "i", span=2).collect()) == [0, 1, 3, 9]


