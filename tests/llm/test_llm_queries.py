"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import numpy as np
import pytest
from oracle import assert_same
from test_llm_operators import brute_components, brute_kept, brute_leaks, brute_verdict, pairs
from tokenizers import Tokenizer

import corpus_pipeline
from shalebed.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, t) for i, t in pairs(docs) if brute_verdict(t)]
    first = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    rows = [r for r in rows if r[0] in first]
    cut = {i: (n, t) for i, _, n, t in brute_kept(rows, 13)}
    rows = [(i, cut[i][1] if cut[i][0] else t) for i, t in rows]
    leaks = {i for i, _ in brute_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))}
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i not in leaks}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
    for _, stage in (corpus_pipeline.STAGES[0], *corpus_pipeline.STAGES[2:4]):
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_at_the_edges(spark, sf_dir):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, "a b c", "en", "s", 5), (3, "x y " * 40, "en", "s", 160), (3, "x y " * 40, "en", "s", 160)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("lang", "kept")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= len(data) and set(docs.columns) - {"text"} <= set(out.columns)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Values, not names: columns called as the operators call theirs come through every stage."""
    names = ["owner", "part", "passage", "kept", "removed", "n_words", "key_a", "verdict", "h", "item"]
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base + f" Tail {i} of some more words that are its own number {i * 7919}" * (i % 2), f"s{i}", *(f"{n}{i}" for n in names)) for i in range(1, 4)] + [(9, " ".join(f"other{i}" for i in range(40)), "s", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mine = {r[0]: r[2:] for r in rows}
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).select("doc_id", "source", *names).collect()
        assert out and all(tuple(r)[1:] == mine[r.doc_id] for r in out)
        if stage is not corpus_pipeline.drop_near_duplicates:
            assert {r.doc_id for r in out} == set(mine)


def test_columns_of_queries(spark, sf_dir):
    """The digests and sums of op5 and op6 against the library and brute force."""
    import hashlib

    docs = pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    for r in queries.op5_bpe(spark, sf_dir).collect():
        ids = library.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    want = {i: (n, k, sha(t.encode())) for i, n, k, t in brute_kept(docs, 13)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_passages(spark, sf_dir).collect()} == want
    assert all(r.n_chars == len(r.text) for r in queries.op8_html(spark, sf_dir).collect())
