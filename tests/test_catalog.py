"""Every query of the engine against its SQL; the others at least run."""

import pytest
from oracle import assert_same

from shalebed import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert_same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_similar_blocks_of_all_vectors(spark, tmp_path):
    docs = [(i, "\n".join(f"line {i} {k}" for k in range(256))) for i in range(12)]
    vectors = [(i, [1.0, 0.1 * i]) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.queries()["search_similar_with_lines"](spark, str(tmp_path)).collect()
    assert {r.block_id: r.n_lines for r in found} == {i: 256 for i in range(12)}


def test_sizes_are_of_compressed_bytes(spark, tmp_path):
    docs = [(1, "a", "many words " * 900), (2, "a", "and more " * 900), (3, "b", "q7"), (4, "b", "")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {r.file_name: r for r in catalog.queries()["multi_file_list"](spark, str(tmp_path)).collect()}
    assert {k: r.original_size for k, r in sizes.items()} == {"a": 18000, "b": 2, None: 18002}
    assert sizes["a"].compressed_size < 1000 and sizes["b"].compressed_size > 2
    assert sizes[None].compressed_size == sizes["a"].compressed_size + sizes["b"].compressed_size and sizes["a"].ratio < 0.1
    stored = {r.doc_id: r.stored for r in catalog.queries()["stored_fallback"](spark, str(tmp_path)).collect()}
    assert stored[1] is stored[2] is False and stored[3] is True


def test_an_empty_text_has_no_ratio(spark, tmp_path):
    docs = [(1, "many words " * 900), (2, ""), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.queries()["zstd_ratio"](spark, str(tmp_path)).collect()}
    assert got[1].ratio < 0.1 and (got[2].size, got[2].ratio, got[2].stored) == (0, None, True) and got[3].size is got[3].ratio is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
