"""Micro-batches are appended once, with numbers that run on."""

import time


from shalebed.operators import search
from shalebed.streaming import ingest


def test_stream_appends_each_batch_once(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.log").write_text("one needle\ntwo\n\n")
    ingest.ingest(ingest.text_stream(spark, str(src)), out, checkpoint, 2, once=True).awaitTermination(60)
    time.sleep(1)
    (src / "b.log").write_text("three\nfour needle\n")
    ingest.ingest(ingest.text_stream(spark, str(src)), out, checkpoint, 2, once=True).awaitTermination(60)
    lines, blocks = (spark.read.parquet(f"{out}/{t}") for t in ("lines", "blocks"))
    assert [(r.line_no, r.block_id, r.line) for r in lines.orderBy("line_no").collect()] == [(0, 0, "one needle"), (1, 0, "two"), (2, 1, ""), (3, 2, "three"), (4, 2, "four needle")]
    assert sorted(r.line_no for r in search.search(lines, blocks, "needle").collect()) == [0, 4]
    again = spark.createDataFrame([("s", "four needle")], "source string, line string")
    ingest.append_batch(again, 1, out, 2)
    assert spark.read.parquet(f"{out}/lines").count() == 5


def test_stream_counts(spark, tmp_path):
    (tmp_path / "a.log").write_text("needle\nx\nneedle\n")
    q = ingest.counts(ingest.text_stream(spark, str(tmp_path)), "needle").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT n_lines FROM seen").first()[0] == 2


def test_a_streamed_archive_is_an_archive(spark, tmp_path):
    from shalebed.sources.archive import Archive

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k, text in enumerate(("one needle\ntwo\n", "three\n", "\nfour needle\nfive\n")):
        (src / f"{k}.log").write_text(text)
        ingest.ingest(ingest.text_stream(spark, str(src)), out, str(tmp_path / "cp"), 2, once=True).awaitTermination(60)
        time.sleep(1)
    a = Archive(spark, out)
    assert sorted(r.line_no for r in a.search("needle").collect()) == [0, 4] and a.count("needle").first()[0] == 2
    assert [r.line for r in a.reconstruct().collect()] == ["one needle", "two", "three", "", "four needle", "five"]
    assert a.get_row(5).first().line == "five" and a.stats().first().row_count == 6
    a.append(spark.createDataFrame([(0, "six")], "line_no long, line string"))
    assert Archive(spark, out).get_row(6).first().line == "six"
