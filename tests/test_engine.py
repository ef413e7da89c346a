"""Compiler, parsers, facets, ranking, spelling, snippets and works on small hand-made tables."""

import random

import pytest

from lectern.functions import text
from lectern.functions.analysis import Analyzer, ends_sentence, sections_with_gaps
from lectern.operators import facets, ranking, snippets, spelling, works
from lectern.plans import parse_text, parse_xml, rewrite
from lectern.plans.ast import ALL, And, AllDocs, Keyword, Near, Not, Or, OrNear, QueryError, Range, SpanFirst, Term, Wildcard
from lectern.plans.compile import Compiler, deduped, hits
from lectern.plans.index import index_table

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (2, "the brown dog and the quick cat", "en"),
    (3, "le chien brun", "fr"),
    (4, "", "fr"),
    (5, None, None),
    (6, "dog brown quick", "en"),
]


@pytest.fixture(scope="module")
def index(spark):
    return index_table(spark.createDataFrame(TEXTS, "doc_id long, text string, lang string"), "doc_id", ["text"], ["lang"])


def ids(index, node, limit=50):
    return sorted(r.doc_id for r in Compiler(index, limit).spans(node).select("doc_id").distinct().collect())


T = Term


@pytest.mark.parametrize(
    ("node", "expected"),
    [
        (T("brown"), [1, 2, 6]),
        (T("absent"), []),
        (Or((T("chien"), T("fox"))), [1, 3]),
        (And((T("fox"), T("cat")), proximity=False), []),
        (And((T("quick"), T("dog"))), [1, 2, 6]),
        (And((T("dog"), T("en", "lang"))), [1, 2, 6]),
        (Not(T("dog")), [3, 4, 5]),
        (And((T("dog"), Not(T("fox"))), proximity=False), [2, 6]),
        (Near((T("quick"), T("brown")), 0, True), [1]),
        (Near((T("brown"), T("quick")), 0, True), [6]),
        (Near((T("quick"), T("brown")), 0), [1]),
        (Near((T("quick"), T("brown")), 3), [1, 6]),
        (Near((T("quick"), T("dog")), 5), [2, 6]),
        (Near((T("le"), T("chien"), T("brun")), 0, True, True), [3]),
        (Near((T("dog"), T("brown")), 0, True, True), []),
        (SpanFirst(T("dog"), 1), [6]),
        (Wildcard("qu*k"), [1, 2, 6]),
        (Range("text", "d", "dz"), [1, 2, 6]),
        (OrNear((T("quick"), T("cat")), 2), [1, 2, 6]),
        (Keyword(("dog", "en"), ("text", "lang")), [1, 2, 6]),
        (AllDocs(), [1, 2, 3, 4, 5, 6]),
    ],
)
def test_nodes(index, node, expected):
    assert ids(index, node) == expected


def test_term_limit(index):
    assert ids(index, Wildcard("*o*"), 10) == [1, 2, 6]
    with pytest.raises(QueryError):
        ids(index, Wildcard("*o*"), 2)
    with pytest.raises(QueryError):  # a range fails already when it reaches the limit
        ids(index, Range("text", "dog", "dog"), 1)


def test_empty_table(spark):
    empty = index_table(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"])
    assert ids(empty, T("dog")) == [] and ids(empty, Near((T("a"), T("b")), 3)) == [] and ids(empty, Not(T("a"))) == []


def test_scores_and_dedupe(index):
    found = {r.doc_id: r for r in hits(Compiler(index).spans(T("the"))).collect()}
    assert found[1].total_hits == 2 and found[2].score > found[1].score
    near = Compiler(index).spans(Near((T("the"), T("quick")), 20))
    for r in deduped(near).groupBy("doc_id").count().collect():
        assert r["count"] == 1


def test_parse_xml():
    request = parse_xml.parse('<query maxDocs="all" startDoc="11" sortDocsBy="title"><near slop="5" field="text"><term>A</term><term>b*</term><not><term>c</term></not></near></query>')
    assert request.start == 10 and request.most == ALL and request.sort == "title"
    assert request.query == And((Near((T("a"), Wildcard("b*")), 5), Not(T("c"))))
    for bad in ("<query/>", "<query><term>a</term></query>", '<query><near field="text"><term>a</term></near></query>', '<query maxDocs="1"><and maxDocs="2" field="text"><term>a</term></and></query>', '<query><phrase field="text"><term>a</term><not><term>b</term></not></phrase></query>', '<query><and field="a"><term field="b">x</term></and></query>', "<query><"):
        with pytest.raises(QueryError):
            parse_xml.parse(bad)


def test_freeform():
    assert parse_text.freeform("a b OR c") == And((T("a"), Or((T("b"), T("c")))))
    assert parse_text.freeform('"big dog" -cat') == And((Near((T("big"), T("dog")), 0, True), Not(T("cat"))))
    assert parse_text.freeform("-cat") == And((AllDocs(), Not(T("cat"))))
    assert parse_text.freeform("title:Dog cat") == And((T("Dog", "title"), T("cat", "title")))
    assert parse_text.freeform("(a OR b) +c") == And((Or((T("a"), T("b"))), T("c")))
    for bad in ("", "(a", "a)", '""'):
        with pytest.raises(QueryError):
            parse_text.freeform(bad)


def test_cql_and_parameters():
    assert parse_text.cql('title exact "big dog"') == Near((T("big", "title"), T("dog", "title")), 0, True)
    assert parse_text.cql('text any "a b" not c') == And((Or((T("a"), T("b"))), Not(T("c"))), False)
    assert parse_text.cql("year >= 1900") == Range("year", "1900", None, True, True)
    request = parse_text.parameters({"text": "a b", "text-join": "or", "text-exclude": "c", "f1-subject": "X::Y", "startDoc": "21"})
    assert request.start == 20 and request.facets[0].select == "X::Y|X::Y::*|X::Y[siblings]"


def test_rewrites():
    assert rewrite.folded(T("CAFÉS"), True, {"cafes": "cafe"}) == T("cafe")
    stops = frozenset({"the", "of"})
    assert rewrite.without_stop_words(And((T("the"), T("dog"))), stops) == And((T("dog"),))
    assert rewrite.without_stop_words(T("the"), stops) is None
    assert rewrite.without_stop_words(Near((T("of"), T("war")), 0, True), stops) == Near((T("of"), T("war")), 0, True)
    assert rewrite.flattened(Or((Or((T("a"), T("b"))), T("c")))) == Or((T("a"), T("b"), T("c")))
    assert rewrite.corrected(Or((T("a"), T("b"))), {"a": "x y", "b": ""}) == Or((Near((T("x"), T("y")), 10),))
    assert rewrite.refielded(T("a", "title"), {"title": "text"}) == T("a")


GROUPS = [("US::California::Berkeley", 1), ("US::California::Albany", 2), ("US::Nevada", 3), ("US::Nevada", 4), ("FR", 5), ("", 6), ("US::California::Berkeley", 7)]


def test_facets(spark):
    values = spark.createDataFrame([(d, v) for v, d in GROUPS] + [(1, "US::Nevada")], "doc_id long, value string")
    own = spark.createDataFrame([(d, float(d)) for d in range(1, 8)], "doc_id long, score double")
    counted = {r.path: r.total_docs for r in facets.counts(own, values).collect()}
    assert counted == {"US": 5, "US::California": 3, "US::California::Berkeley": 2, "US::California::Albany": 1, "US::Nevada": 3, "FR": 1, "<empty>": 1}

    def pick(selector, sort="totalDocs"):
        root = facets.tree(facets.counts(own, values), sort)
        return [g.path for g in facets.select(root, selector)]

    assert pick("US::*") == ["US::California", "US::Nevada"]
    assert pick("*[1]") == ["US"]
    assert pick('US::"California"::*[2]') == ["US::California::Albany"]
    assert pick("US::**") == ["US", "US::California", "US::California::Berkeley", "US::California::Albany", "US::Nevada"]
    assert pick("US|*[unselected]") == ["US", "<empty>", "FR"]
    assert pick("US::Nevada[siblings]") == ["US::California", "US::Nevada"]
    assert pick("**[topChoices]") == ["US", "<empty>", "FR"]
    assert pick("*[3][page(size=2)]") == ["FR"]
    assert pick("*[empty]") == []
    assert pick("FR|**[selected][singleton]") == ["FR"]
    root = facets.tree(facets.counts(own, values))
    facets.select(root, "US::Nevada#1-2|**[topChoices]")
    assert [g.documents for g in root.below() if g.path == "US::Nevada"] == [(1, 2)]
    assert ("US", 0, 2, 5, True) in facets.result_rows(root)
    with pytest.raises(QueryError):
        facets.parse_selector("a||b")
    narrowed = facets.counts(own.where("doc_id = 5"), values, True)
    assert {r.path: r.total_docs for r in narrowed.collect()}["US"] == 0


def test_sorting(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (2, None, 3.0), (3, "a", 2.0), (4, "", 4.0)], "doc_id long, title string, score double")
    order = lambda spec: [r.doc_id for r in rows.orderBy(*ranking.order_by(rows, spec)).collect()]
    assert order("title") == [3, 1, 2, 4] and order("-title") == [1, 3, 2, 4]
    assert order("title:descending:emptyFirst") == [2, 4, 1, 3] and order("score") == [4, 2, 3, 1] and order("") == [4, 2, 3, 1]
    for bad in ("title:ascending:descending", "+title:descending", "score:ascending", "title:odd"):
        with pytest.raises(QueryError):
            ranking.sort_keys(bad)
    assert ranking.read_boosts(["a|2", "b|0.5", "a|3", "z|1"]) == [("a", 2.0), ("b", 0.5)]
    boosts = spark.createDataFrame([("x", 2.0), ("y", 0.0)], "key string, boost double")
    keys = spark.createDataFrame([(1, "x"), (2, "y"), (3, "none")], "doc_id long, key string")
    assert {r.doc_id: r.score for r in ranking.boosted(rows, keys, boosts, 2.0, 1.0).collect()} == {1: 4.0, 3: 2.0, 4: 4.0}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("2004-01-31",), ("none",), (None,), ("-1.5",)], "v string")
    assert [r[0] for r in rows.select(text.digits_as_number(F.col("v"))).collect()] == [20040131, 0, None, 15]
    assert [r[0] for r in rows.limit(1).select(text.year(F.lit("c 1799, 1850-60"))).collect()] == [1850]
    assert text.year_of("c 1799, 1850-60") == 1850 and text.year_of(None) is None
    assert text.edit_distance("word", "word") == 0 and text.edit_distance("word", "wodr") == 1 and text.edit_distance("word", "ward") == 2
    assert text.edit_distance("wordd", "word") == 1 and text.edit_distance("", "ab") == 2 and text.edit_distance("ab", "") == 4
    assert text.sound_key("phone") == text.sound_key("fone") and text.fold_accents("Épée") == "Epee" and text.copy_case("Dog", "cat") == "Cat"


def test_analysis():
    plain = Analyzer(sentence_gap=5)
    assert [t for t, _ in plain.terms("John's U.S.A. AT&T a@b.org 61.7 $5 日本")] == ["john", "usa", "at&t", "a@b.org", "61.7", "$", "5", "日", "本"]
    assert plain.terms("One. Two")[1] == ("two", 6) and plain.terms("61.7 x")[1] == ("x", 1)
    assert not ends_sentence("a... b") and ends_sentence("a!?! b")
    stops = Analyzer(stop_words=frozenset({"of"}))
    assert stops.bigrams("man of war") == [("man", 0), ("man~of", 0), ("of~war", 1), ("war", 2)]
    assert sections_with_gaps([("a", 0, False), ("a", 2, False), ("b", 0, False), ("b", 0, True)], 10) == [0, 3, 14, 25]


def test_snippets():
    body = "one two three four five six seven eight nine ten"
    made = snippets.snippets_of(body, [(1, 3, 1.0), (2, 4, 0.5), (7, 8, 2.0)], {"two", "eight"}, max_context=24)
    assert [m[:2] for m in made] == [(1, 100), (2, 50)]
    assert "<hit><term>eight</term></hit>" in made[0][2] and "<hit><term>two</term> three</hit>" in made[1][2]
    assert all(len(m[2].replace("<hit>", "").replace("</hit>", "").replace("<term>", "").replace("</term>", "")) <= 24 for m in made)
    assert snippets.snippets_of("", [(0, 1, 1.0)], set()) == []
    assert snippets.mark_document(body, [(0, 1, 1.0)]).startswith('<hit number="1">one</hit> two')


def test_spelling(spark):
    words = ["house"] * 9 + ["horse"] * 5 + ["mouse"] * 3 + ["red", "house"] * 4 + ["rare"]
    postings = index_table(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), "doc_id", ["text"]).postings
    speller = spelling.Speller(spelling.word_counts(postings), spelling.pair_counts(postings))
    assert speller.suggest_word("huose") == "house" and speller.suggest_word("house") is None and speller.suggest_word("redhouse") == "red house"
    assert speller.suggest(["red", "huose"]) == [None, "house"]
    assert len(spelling.keys_of("abcdef")) == 15 and len(spelling.keys_of("ab")) <= 14


def test_works(spark):
    records = [
        (1, "Moby Dick tale: or the whale", "Herman Melville", "1851", None),
        (2, "Moby Dick tale: another subtitle", "Melville, Herman", "1851", None),
        (3, "Moby Dick tale: or the whale", "Somebody Else", "1990", None),
        (4, None, None, None, None),
        (5, "Moby Dick tale: or the whale", "Herman Melville", "1851", None),
    ]
    made = {r.doc_id: r.work_id for r in works.works(spark.createDataFrame(records, "doc_id long, title string, author string, date string, id string")).collect()}
    assert made == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert works.author_score("", "") == 75 and works.date_score("1850", "1851") == -40 and works.id_score("abcdef (x)", "abcdef (y)") == 80


def test_works_of_a_large_block(spark):
    """More records of the same first word change nothing, and what the index leaves out scores too little."""
    rng = random.Random(5)
    pick = lambda values: rng.choice(values)
    small = [(1, "History of England", "Ann Author", "1850", None), (2, "History of England a survey", "Ann Author", "1850", None), (3, "History wholly other", "Ann Author", "1850", "id 12345"), (4, "History unlike", "Ann Author", "1850", "id 12345")]
    many = small + [(10 + i, f"History number{i}", f"writer{i}", "1900", None) for i in range(2100)]
    schema = "doc_id long, title string, author string, date string, id string"
    made = {r.doc_id: r.work_id for r in works.works(spark.createDataFrame(many, schema)).collect()}
    assert [made[i] for i in (1, 2, 3, 4)] == [1, 1, 3, 3]
    titles = [None, "***", ":", *(f"a {x}{y}" for x in ("", "b", "b c", "long enough title", "d") for y in ("", ": e", " f", ": b c"))]
    rows = [dict(doc_id=i, title=pick(titles), author=pick([None, "x", "x y", "long name", "long name z"]), date=pick([None, "1850", "1851", "[c]1850"]), id=pick([None, "abcdef (x)", "abcdef (y)", "12"])) for i in range(300)]
    assert sorted(works.group_block(rows)) == sorted(all_pairs(rows))


def all_pairs(rows):
    made = {}
    for i, a in enumerate(rows):
        if a["doc_id"] in made:
            continue
        made[a["doc_id"]] = (a["doc_id"], 0)
        for b in rows[i + 1 :]:
            if b["doc_id"] not in made and (score := works.pair_score(a, b)) >= works.LEAST:
                made[b["doc_id"]] = (a["doc_id"], score)
    return [(d, w, s) for d, (w, s) in made.items()]
