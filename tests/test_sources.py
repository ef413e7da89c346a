"""Formats, index versions and streaming ingest."""

import pytest

from lectern.plans.ast import QueryError, Term
from lectern.plans.compile import Compiler
from lectern.plans.index import index_table
from lectern.sources import formats, store, subdocuments
from lectern.streaming import ingest


def marc(*records):
    out = b""
    for fields in records:
        directory, data = b"", b""
        for tag, value in fields:
            raw = value.encode() + b"\x1e"
            directory += f"{tag}{len(raw):04d}{len(data):05d}".encode()
            data += raw
        base = 24 + len(directory) + 1
        total = base + len(data) + 1
        out += f"{total:05d}nam a22{base:05d} a 4500".encode().ljust(24)[:24] + directory + b"\x1e" + data + b"\x1d"
    return out


def test_formats(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text("<doc><title>A title</title><body>Some <b>bold</b> text</body></doc>")
    (tmp_path / "bad.xml").write_text("<doc><open></doc>")
    (tmp_path / "sub" / "b.html").write_text("<html><head><title>Page</title><script>x()</script></head><body><p>Hello</p><p>World</p></body></html>")
    (tmp_path / "c.txt").write_text("plain words")
    (tmp_path / "d.mrc").write_bytes(marc([("001", "id1"), ("245", "10\x1faMoby Dick\x1fcMelville")], [("245", "10\x1faOther")]))
    (tmp_path / "e.bin").write_bytes(b"\x00")
    rows = {(r.path.rsplit("/", 1)[1], r.record_num): r for r in formats.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a.xml", 0), ("bad.xml", 0), ("b.html", 0), ("c.txt", 0), ("d.mrc", 1), ("d.mrc", 2)}
    assert rows["a.xml", 0].title == "A title" and rows["a.xml", 0].text == "Some bold text"
    assert rows["bad.xml", 0].error and rows["b.html", 0].text == "Hello\nWorld" and rows["b.html", 0].title == "Page"
    assert rows["d.mrc", 1].meta["245a"] == ["Moby Dick"] and rows["d.mrc", 2].title == "Other"
    skipped = formats.read_tree(spark, str(tmp_path), {r"\.txt$": "skip"})
    assert skipped.where("path like '%.txt'").count() == 0
    assert formats.xml_head("<a><title>x</title>" + "<p/>" * 9, "title") == "<title>x</title>"


def index(spark, rows):
    return index_table(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"])


def test_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    store.publish(spark, root, index(spark, [(1, "a dog"), (2, "a cat")]), [(Term("dog"), 1)])
    opened = store.current(spark, root)
    with pytest.raises(QueryError):
        store.publish(spark, root, index(spark, [(3, "a bird")]), [(Term("dog"), 1)])
    store.publish(spark, root, index(spark, [(4, "two dog")]))
    assert Compiler(opened).spans(Term("cat")).count() == 1
    assert [r.doc_id for r in Compiler(store.current(spark, root)).spans(Term("dog")).collect()] == [4]
    store.compact(spark, root)
    assert Compiler(store.current(spark, root)).spans(Term("dog")).count() == 1


def test_merge_and_cull(spark):
    a, b = index(spark, [(1, "dog")]), index(spark, [(2, "cat dog")])
    assert Compiler(store.merge(a, b)).spans(Term("dog")).count() == 2
    other = index_table(spark.createDataFrame([(3, "x")], "doc_id long, text string"), "doc_id", ["text"], overlap=5)
    with pytest.raises(QueryError):
        store.merge(a, other)
    culled = store.cull(store.merge(a, b), spark.createDataFrame([(2,)], "doc_id long"))
    assert [r.doc_id for r in Compiler(culled).spans(Term("dog")).collect()] == [2]


def test_inheritance(spark):
    parts = spark.createDataFrame([(11, 1, None, True), (12, 1, "own", True), (13, 1, None, False)], "doc_id long, parent_id long, subject string, inherit boolean")
    parents = spark.createDataFrame([(1, "theirs")], "doc_id long, subject string")
    assert {r.doc_id: r.subject for r in subdocuments.inherit(parts, parents, ["subject"]).collect()} == {11: "theirs", 12: "own", 13: None}


def test_streaming(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "old words"), (2, "more words")], "doc_id long, text string").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest.start(spark, source, schema, path).awaitTermination()
    spark.createDataFrame([(1, "new text")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    ingest.start(spark, source, schema, path).awaitTermination()
    assert {(r.doc_id, r.text) for r in ingest.latest(spark, path).collect()} == {(1, "new text"), (2, "more words")}
    assert sorted((r.doc_id, r.term) for r in ingest.latest_postings(spark, path).collect()) == [(1, "new"), (1, "text"), (2, "more"), (2, "words")]
