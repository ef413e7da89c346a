"""Whole requests."""

import pytest

from lectern.operators import facets, spelling
from lectern.plans.ast import And, Near, QueryError, Term
from lectern.plans.index import index_table
from lectern.plans.search import search, view

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "animals::fox", "B"),
    (2, "the brown dog and the quick cat", "animals::dog", "A"),
    (3, "a house and a dog house near the red house", "places", None),
    (4, "red house red house", "places", "C"),
]


@pytest.fixture(scope="module")
def index(spark):
    return index_table(spark.createDataFrame(ROWS, "doc_id long, text string, subject string, title string"), "doc_id", ["text"], ["subject"], stop_words=frozenset({"the", "a", "and"}))


def test_request(index):
    result = search(index, '<query maxDocs="2" sortDocsBy="title" maxContext="20" explainScores="yes"><facet field="subject" select="**"/><and field="text"><term>the</term><term>Dog</term></and></query>')
    page = result.page.collect()
    assert result.total_docs == 3 and [r.doc_id for r in page] == [2, 1] and page[0].explanation.spans == 1
    assert max(r.score for r in search(index, '<query><term field="text">dog</term></query>').page.collect()) == 1.0
    assert {(p, n) for p, _, _, n, s in result.facets["subject"] if s and p} == {("animals", 2), ("animals::fox", 1), ("animals::dog", 1), ("places", 1)}
    assert all("<hit><term>dog</term></hit>" in r.snippet for r in result.snippets.collect())


def test_stop_words_alone(index):
    assert search(index, '<query><term field="text">the</term></query>').total_docs == 0


def test_boosts_and_dynamic_facets(spark, index):
    table = spark.createDataFrame([("A", 0.0), ("B", 5.0)], "key string, boost double")
    request = '<query boostSet="s" boostSetField="title"><facet field="call:initial(1)" select="*"/><term field="text">dog</term></query>'

    @facets.dynamic("initial")
    def initial(hits, arguments):
        return index.documents.selectExpr("doc_id", f"substring(title, 1, {int(arguments)}) as value")

    result = search(index, request, {"s": table})
    assert [r.doc_id for r in result.page.orderBy("doc_id").collect()] == [1, 3]
    assert {(p, n) for p, _, _, n, s in result.facets["call:initial(1)"] if s} == {("B", 1), ("<empty>", 1)}
    with pytest.raises(QueryError):
        search(index, request)


def test_suggestions(index):
    speller = spelling.Speller(spelling.word_counts(index.postings, tuple(index.stop_words)), spelling.pair_counts(index.postings, tuple(index.stop_words)))
    assert search(index, '<query><spellcheck/><term field="text">huose</term></query>', speller=speller).suggestions == {"huose": "house"}
    assert search(index, '<query><spellcheck totalDocsCutoff="0"/><term field="text">dog</term></query>', speller=speller).suggestions == {}


def test_view(index):
    assert view(index, 4, Near((Term("red"), Term("house")), 0, True)) == '<hit number="1">red house</hit> <hit number="2">red house</hit>'
    assert view(index, 4) == "red house red house" and view(index, 1, And((Term("cat"),))) == ROWS[0][1]
    with pytest.raises(QueryError):
        view(index, 9)
