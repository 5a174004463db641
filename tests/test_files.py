from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.plans.stages import Providers, Run, Stage
from quire.sources import readers, writers
from quire.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Book One.txt").write_text("Preface\t here\r\n\nCHAPTER I\n" + "Mary met John. \n" * 60 + "CHAPTER II\n" + "The end. \n" * 80, encoding="utf-8")
    (tmp_path / "latin.md").write_bytes("caf\xe9  noir\nzwei".encode("latin-1"))
    (tmp_path / "scan.PDF").write_bytes(b"%PDF page")
    (tmp_path / "x.bin").write_bytes(b"\x00")
    return tmp_path


def test_documents(spark, folder):
    rows = {r.document_id: r for r in readers.documents(spark, str(folder), pattern="*.{txt,md}").collect()}
    assert rows["Book One"].text.startswith("Preface here\n\nCHAPTER I\nMary") and rows["Book One"].encoding == "utf-8"
    assert (rows["latin"].text, rows["latin"].encoding) == ("caf\xe9 noir zwei", "latin-1")
    with pytest.raises(AnalysisException):
        readers.documents(spark, str(folder / "missing")).count()
    got = {r.document_id: r.success for r in readers.library_files(spark, str(folder)).collect()}
    assert got == {"Book One": True, "latin": False, "scan": False, "x": False}
    assert readers.library_files(spark, str(folder), pdf_text=lambda b: ["a", "b"]).where("document_id = 'scan'").collect()[0].text == "a\nb"


def test_series_and_matrices(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Open,Close\n2020-01-02 09:30,1,2.5\n2020-01-03,,4\n")
    assert [(str(r.Date), r.Open, r.Close) for r in readers.series(spark, str(tmp_path / "s.csv")).orderBy("Date").collect()] == [("2020-01-02", 1.0, 2.5), ("2020-01-03", None, 4.0)]
    (tmp_path / "m.txt").write_text("1 2\n 3\t4 \n\n\n5 6\n")
    assert [(r.i, r.row) for r in readers.matrix(spark, str(tmp_path / "m.txt")).orderBy("i").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    assert [(r.m, r.i, r.row) for r in readers.matrices(spark, str(tmp_path / "m.txt")).orderBy("m", "i").collect()] == [(0, 0, [1, 2]), (0, 1, [3, 4]), (1, 0, [5, 6])]
    (tmp_path / "c.txt").write_text("a; b\nc ;d\n")
    assert [r.row for r in readers.matrix(spark, str(tmp_path / "c.txt"), separator=";", numbers=False).orderBy("i").collect()] == [["a", "b"], ["c", "d"]]
    (tmp_path / "f.txt").write_text("1.5\n2\n")
    assert [r.value for r in readers.flat_numbers(spark, str(tmp_path / "f.txt")).orderBy("i").collect()] == [1.5, 2.0]
    (tmp_path / "j.json").write_text('{"a": [1, "x"]}')
    assert readers.json_object(spark, str(tmp_path / "j.json")).select(F.variant_get("value", "$.a[1]", "string").alias("v")).collect()[0].v == "x"


def test_writers(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("row "), "id").alias("t"))
    writers.write_lines(df, str(tmp_path / "lines"), F.col("t"), "id")
    parts = sorted(p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"row {i}" for i in range(100)]
    writers.save_version(df.limit(3), str(tmp_path / "v"))
    old = writers.current_version(spark, str(tmp_path / "v"))
    writers.save_version(old.where("id > 0"), str(tmp_path / "v"))
    assert writers.current_version(spark, str(tmp_path / "v")).count() == 2 and old.count() == 3
    m = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [3, 4]), (1, 1, [5, 6])], "m int, i int, row array<int>")
    assert [r.line for r in writers.matrix_lines(m, blank=2).orderBy("m", "i").collect()] == ["1\t2", "", "", "3\t4", "5\t6"]
    writers.write_table(df, str(tmp_path / "tsv"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 100
    assert df.limit(1).select(writers.qa_line(F.lit("q"), F.lit("caf\xe9"), F.lit("a")).alias("l")).collect()[0].l == "Q: q\ncaf\nA: a"


def _chunk_answer(prompt: str) -> str:
    return '{"entities":{"characters":[{"name":"Mary","mentioned_or_present":"present"},{"name":"John"}],"locations":[]},"relationships_interactions":[{"participants":["Mary","John"],"summary":"met"}]}'


def test_stages_run_and_resume(spark, folder, tmp_path):
    source = readers.documents(spark, str(folder), pattern="*.{txt,md}")
    run = Run(spark, str(tmp_path / "stages"), Providers(chunk=_chunk_answer), target=100, overlap=10)
    run.run(source)
    assert {r.structural_marker for r in run.load("blocks").where("key = 'Book One'").collect()} == {"DetectedStructure Unit 1", "Chapter I", "Chapter II"}
    assert run.load("embeddings").count() == run.load("chunks").count() > 3
    assert {"character_mary", "character_john", "Book One", "latin"} == {r.id for r in run.load("nodes").collect()}
    again = Run(spark, str(tmp_path / "stages"), Providers(chunk=_chunk_answer))
    stored = {f"stored/{x}" for x in ("vectors", "nodes", "edges", "chunks")}
    assert set(again.run(start=Stage.EMBEDDINGS)) == {"nodes", "edges", *stored}
    assert set(Run(spark, str(tmp_path / "stages")).run(start=Stage.GRAPH)) == stored
    held = {x: writers.current_version(spark, str(tmp_path / "stages" / "stored" / x)) for x in ("vectors", "nodes", "edges", "chunks")}
    assert held["vectors"].count() == held["chunks"].count() == run.load("chunks").count()  # stored three times, there once
    assert {r.id for r in held["nodes"].collect()} == {"character_mary", "character_john", "Book One", "latin"} and held["edges"].count() == run.load("edges").count() > 0
    assert held["vectors"].columns == ["chunk_id", "vector", "text", "document_id", "sequence", "structure_ref"]
    with pytest.raises(ValueError, match="no text"):
        Run(spark, str(tmp_path / "none")).run(source.limit(0))


def test_stages_keep_any_document_id(spark, tmp_path):
    source = spark.createDataFrame([("a#1", "CHAPTER 1\n" + "One went home. " * 40 + "\nCHAPTER 2\n" + "Two came back. " * 40), ("a", "Three stayed. " * 40)], "document_id string, text string")
    run = Run(spark, str(tmp_path / "odd"), Providers(chunk=_chunk_answer), target=100, overlap=10)
    run.run(source)
    assert {r.document_id for r in run.load("doc_analyses").collect()} == {"a#1", "a"}
    assert {r.id for r in run.load("nodes").collect()} >= {"a#1", "a"}


def test_log_and_reset(spark, tmp_path):
    from quire.operators import library as lib

    rows = spark.createDataFrame([(1, "q?", "caf\u00e9", None)], "q_id int, question string, context string, answer string")
    for _ in range(2):
        lib.log_answers(rows, str(tmp_path / "log"))
    assert [(r.q_id, r.context, r.answer) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("1", "caf", "")] * 2
    docs = spark.createDataFrame([("d", "Name", None, None, 0, None, 0)], "document_id string, doc_name string, subject string, date_added timestamp_ntz, chunk_overlap int, file_path string, doc_order int")
    chunks = spark.createDataFrame([("d", 0, 0, "x"), ("d", 0, 1, "y")], "document_id string, doc_order int, sequence int, text string")
    names = ("reset_docs", "reset_chunks")
    with pytest.raises(PermissionError):
        lib.reset(spark, *names, docs, chunks, allowed=names)
    for _ in range(2):
        lib.reset(spark, *names, docs, chunks, allowed=names, confirm=True)
    assert [(r.chunk_num, r.text) for r in spark.table("reset_chunks").orderBy("chunk_num").collect()] == [(0, "x"), (1, "y")]
    assert [(r.doc_name, r.end_chunk_id) for r in spark.table("reset_docs").collect()] == [("Name", 1)]
    lib.drop_all(spark, *names, allowed=names, confirm=True)


def test_streams(spark, folder, tmp_path, data):
    def keep():
        ingest.keep(ingest.arriving_documents(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return {r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert keep() == {"Book One", "latin", "scan", "x"}
    (folder / "late.txt").write_text("late")
    assert keep() == {"Book One", "latin", "scan", "x", "late"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    src = spark.read.parquet(f"{data}/events.parquet")
    folder2 = tmp_path / "events"
    src.write.parquet(str(folder2))
    counts = ingest.arriving_events(spark, str(folder2), src._jdf.schema().toDDL())
    q = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).collect()[0][0] == src.where("ts is not null").count()
