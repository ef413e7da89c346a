"""What queries read, write and move: in proportion to the texts and to what they find."""

import duckdb
import pytest

from lectern.functions.text import words
from lectern.operators import spelling
from lectern.plans.ast import And, Keyword, Near, Or, Term
from lectern.plans.catalog import ORACLES, QUERIES, STOP_WORDS, documents_index
from lectern.plans.compile import Compiler
from lectern.plans.index import index_table, text_postings
from lectern.sources import store

ROWS = [(1, "the dog of the house and the dog", "en", "a"), (2, "a dog, the cat", "fr", "a"), (3, "le chat", "fr", "b"), (4, "", None, "b"), (5, None, "en", "b")]
REPEATED = [*ROWS, (1, "house", "en", "a"), (None, "the the dog", "fr", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_query_keeps_its_own_words_alone(spark, folder):
    """the whole table was sorted and written before the first query of a session."""
    index = documents_index(spark, folder)
    near, plain = Near((Term("of"), Term("the")), 5), index_table(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", ["text"], ["lang"])
    assert rows(Compiler(index).spans(near)) == rows(Compiler(plain).spans(near))
    assert set(index.kept.parts) == {("text", "of"), ("text", "the")}
    kept = spark.read.parquet(*set(index.kept.parts.values()))
    assert {(r.term, r.doc_id) for r in kept.collect()} == {("of", 1), ("the", 1), ("the", 2)}
    parts = dict(index.kept.parts)
    spans = Compiler(index).spans(Or((Term("the"), Term("of"))))
    assert index.kept.parts == parts and "regexp" not in plan(spans)  # found again without a pass over the texts
    rare = Compiler(index).spans(And((Term("cat"), Term("nowhere"))))
    assert rare.count() == 0 and index.kept.frequency["text", "nowhere"] == 0 and index.kept.frequency["text", "cat"] == 1


def test_words_of_several_fields_are_kept_by_field(spark, folder):
    """keyword and or-queries wrote all words as well."""
    index = documents_index(spark, folder)
    found = Compiler(index).spans(Keyword(("the", "en"), ("text", "lang")))
    assert {r.doc_id for r in found.collect()} == {1}
    assert set(index.kept.parts) == {(f, w) for f in ("text", "lang") for w in ("the", "en")}
    assert rows(QUERIES["or_terms"](spark, folder).select("doc_id", "total_hits")) == ["Row(doc_id=1, total_hits=3)", "Row(doc_id=2, total_hits=1)"]


def test_texts_are_split_once(spark, folder):
    """an inner generator has the planner ask first whether there are words, which split each text a second time."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = index_table(docs, "doc_id", ["text"])
    for df in (text_postings(docs, "text", "text").select("term"), index.term_postings("text", ["the"])):
        assert plan(df).count("regexp_extract_all") == 1
    assert text_postings(docs, "text", "text").count() == 14


def test_a_facet_beside_a_search_keeps_one_word(spark, folder):
    """the groups of one rare word waited for the postings of all words."""
    found = {r.path: r.total_docs for r in QUERIES["facet_with_empty"](spark, folder).collect()}
    assert found == {"en": 0, "fr": 0, "<empty>": 0}
    assert set(documents_index(spark, folder).kept.parts) == {("text", "loser")}


@pytest.mark.parametrize("table", [ROWS, REPEATED])
def test_statistics_without_a_row_for_each_word(spark, table):
    """the words of each document were exchanged to be counted."""
    documents = spark.createDataFrame(table, SCHEMA)
    index = index_table(documents, "doc_id", ["text"], ["lang", "source"])
    assert "Generate" not in plan(index.lengths(["text"]))
    documents = documents.toPandas()
    duck = duckdb.connect()
    duck.register("documents", documents)
    fields = "('text', 'lang', 'source')" if table is ROWS else "('text')"  # the SQL takes each id to have one row
    expected = duck.execute(f"select field, docs, words, terms, chunks from ({ORACLES['index_stats']}) where field in {fields} and field <> 'lang'").fetchall()
    assert sorted(expected) == sorted(tuple(r) for r in store.stats(index).collect() if r.field in fields and r.field != "lang")
    counted = duck.execute(f"select term, doc_freq, freq from ({ORACLES['index_dump']}) where field = 'text'").fetchall()
    assert sorted(counted) == sorted((r.term, r.doc_freq, r.freq) for r in store.dump_terms(index, ["text"]).collect())


def test_suggestions_read_the_tables_once(spark, folder, monkeypatch):
    """each word that was tried had all texts split again for words, keys and pairs."""
    made = []
    monkeypatch.setattr(spelling, "Speller", type("Counting", (spelling.Speller,), {"frequencies": lambda self, w: made.append(self) or super(type(self), self).frequencies(w)}))
    assert QUERIES["spelling_suggestions"](spark, folder).count() == 4
    assert len(made) == 1 and "regexp" not in plan(made[0].words) + plan(made[0].keys)
    postings = text_postings(spark.createDataFrame([(1, "house " * 9 + "horse " * 5 + "red house " * 4)], "doc_id long, text string"), "text", "text")
    speller = spelling.Speller(spelling.word_counts(postings), spelling.pair_counts(postings))
    tried = ["Huose", "house", "redhouse", "xyzzy", "huose"]
    assert speller.suggest_words(tried) == [speller.suggest_word(w) for w in tried] == ["house", None, "red house", None, "house"]


def test_only_a_page_has_its_spans_collected(spark, folder):
    """F8: the spans of all documents found were collected and sorted for ten of them."""
    made = QUERIES["snippets_of_page"](spark, folder)
    assert "doc_id#" in plan(made) and "IN (1)" in plan(made).replace("= 1", "IN (1)") and "GlobalLimit" not in plan(made)
    assert [r.doc_id for r in made.collect()] == [1]


@pytest.mark.parametrize("table", [ROWS, REPEATED])
def test_neighbours_without_sorting_words(spark, tmp_path, table):
    """all words were exchanged and sorted to see which follow each other."""
    docs = spark.createDataFrame([*table, (9, "the dog, THE house theory of dog; andy the and house", "en", "a")], SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = spelling.text_pair_counts(docs, STOP_WORDS, 1)
    assert "Window" not in plan(pairs) and plan(pairs).count("regexp_extract_all") == 1
    single = docs.where("doc_id > 1")
    by_sort = lambda df, stops: rows(spelling.pair_counts(text_postings(df, "text", "text"), stops, 1))
    for stops in ((), STOP_WORDS):
        assert rows(spelling.text_pair_counts(single, stops, 1)) == by_sort(single, stops)
    assert ("Window" in plan(QUERIES["spelling_pairs"](spark, str(tmp_path)))) == (table is REPEATED)  # rows of one id are one document
    assert [r.w for r in docs.where("doc_id = 9").select(words(docs.text, STOP_WORDS).alias("w")).collect()] == [["dog", "house", "theory", "dog", "andy", "house"]]
