"""Every registered query of the search engine, with its DuckDB equivalent. All run over whole tables; limits are pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import digits_as_number, human_size, words, year
from lectern.operators import facets, morelike, ranking, snippets, spelling, works
from lectern.plans import parse_text, parse_xml, rewrite
from lectern.plans.ast import And, AllDocs, InSection, Keyword, MoreLike, Near, Node, Not, Or, OrNear, Range, SpanFirst, SpanNot, Term, Wildcard
from lectern.plans.compile import Compiler, deduped, hits
from lectern.plans.index import Index, index_table, keyword_postings, text_postings
from lectern.sources import formats, store, subdocuments
from lectern.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "le", "la", "de", "les", "der", "die", "und", "el", "los", "que")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents: the first query of a session that asks for a term takes its postings from the texts and keeps them, all others read them."""
    build = lambda: index_table(table(spark, sf_dir, "documents"), "doc_id", ["text"], ["lang", "source"], stop_words=frozenset(STOP_WORDS))
    return store.indexed(spark, f"{sf_dir}/documents.parquet", "documents", build)


def parts_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_table(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], ["p_brand", "p_size"])


def conversations_index(spark: SparkSession, sf_dir: str) -> Index:
    turns = table(spark, sf_dir, "conversations")
    postings, sections = subdocuments.sectioned_postings(turns, "conv_id", ["turn"], "role", "text", 20, "turn")
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    return Index(docs, docs.select(F.lit("").alias("field"), "doc_id", F.lit(0).alias("ord"), F.lit("").alias("value")), postings, sections)


def found(index: Index, node: Node) -> DataFrame:
    """Each document found, with its score to six places and its hits."""
    return hits(Compiler(index).spans(node)).select("doc_id", F.round("score", 6).alias("score"), "total_hits")


def members(index: Index, node: Node) -> DataFrame:
    return Compiler(index).spans(node).select("doc_id").distinct()


TOK = r"""
WITH tok AS (
  SELECT doc_id, term, pos FROM (
    SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents))),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
d AS (SELECT CAST(count(*) AS DOUBLE) AS d FROM documents)
"""


def spans_sql(name: str, word: str) -> str:
    return f"""{name} AS (SELECT t.doc_id, t.pos AS s, t.pos + 1 AS e,
  (1 + ln((SELECT d FROM d) / ((SELECT count(DISTINCT doc_id) FROM tok WHERE term = '{word}') + 1))) / sqrt(n) AS score
  FROM tok t JOIN len USING (doc_id) WHERE term = '{word}')"""


def hits_sql(source: str) -> str:
    return f"SELECT doc_id, round(sqrt(sum(score)), 6) AS score, count(*) AS total_hits FROM ({source}) GROUP BY doc_id"


# leaves


@query(
    "term_top10",
    TOK
    + ", "
    + spans_sql("a", "the")
    + """, h AS (SELECT doc_id, round(sqrt(sum(score)), 6) AS score, count(*) AS total_hits FROM a GROUP BY doc_id)
SELECT doc_id, score, total_hits, (SELECT count(*) FROM h) AS total_docs FROM h ORDER BY score DESC, doc_id LIMIT 10""",
)
def term_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(documents_index(spark, sf_dir), Term("the"))
    total = rows.agg(F.count("*").alias("total_docs"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(10).crossJoin(F.broadcast(total)).select("doc_id", "score", "total_hits", "total_docs")


@query("all_docs", "SELECT doc_id FROM documents")
def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), AllDocs())


@query("term_scores", TOK + ", " + spans_sql("a", "the") + hits_sql("SELECT * FROM a"))
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), Term("the"))


@query("wildcard", TOK + "SELECT doc_id, count(*) AS total_hits FROM tok WHERE regexp_full_match(term, 'idio.*') OR regexp_full_match(term, 'clow.') GROUP BY doc_id")
def wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = Or((Wildcard("idio*"), Wildcard("clow?")))
    return hits(Compiler(documents_index(spark, sf_dir)).spans(node)).select("doc_id", "total_hits")


@query("range_terms", TOK + "SELECT doc_id, count(*) AS total_hits FROM tok WHERE term >= 'idio' AND term <= 'idiot' GROUP BY doc_id")
def range_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(documents_index(spark, sf_dir)).spans(Range("text", "idio", "idiot"))).select("doc_id", "total_hits")


@query("range_numeric", "SELECT p_partkey AS doc_id FROM part WHERE p_size >= 10 AND p_size <= 20")
def range_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(parts_index(spark, sf_dir), Range("p_size", "10", "20", numeric=True))


@query("range_open_exclusive", "SELECT doc_id FROM documents WHERE CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) > 15")
def range_open_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), Range("source", "15", None, inclusive=False, numeric=True))


@query("exact_value", "SELECT p_partkey AS doc_id FROM part WHERE lower(trim(regexp_replace(p_type, '[^a-zA-Z0-9]+', ' ', 'g'))) = (SELECT min(lower(trim(regexp_replace(p_type, '[^a-zA-Z0-9]+', ' ', 'g')))) FROM part)")
def exact_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts_index(spark, sf_dir)
    least = index.documents.select(F.min(F.array_join(words(F.col("p_type")), " "))).first()[0]
    return members(index, Near(tuple(Term(w, "p_type") for w in least.split()), 0, True, True))


@query("span_first", TOK + "SELECT doc_id, count(*) AS total_hits FROM tok WHERE term = 'the' AND pos + 1 <= 20 GROUP BY doc_id")
def span_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(documents_index(spark, sf_dir)).spans(SpanFirst(Term("the"), 20))).select("doc_id", "total_hits")


# boolean


@query("or_terms", TOK + ", " + spans_sql("a", "the") + ", " + spans_sql("b", "idiot") + hits_sql("SELECT * FROM a UNION ALL SELECT * FROM b"))
def or_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), Or((Term("the"), Term("idiot"))))


@query(
    "and_without_proximity",
    TOK + ", " + spans_sql("a", "idiot") + ", " + spans_sql("b", "clown") + hits_sql("SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE doc_id IN (SELECT doc_id FROM a) AND doc_id IN (SELECT doc_id FROM b)"),
)
def and_without_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), And((Term("idiot"), Term("clown")), proximity=False))


@query("and_across_fields", TOK + ", " + spans_sql("a", "the") + "SELECT DISTINCT doc_id FROM a JOIN documents USING (doc_id) WHERE lang = 'en' AND source = 'src3'")
def and_across_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), And((Term("the"), Term("en", "lang"), Term("src3", "source"))))


@query("not_alone", TOK + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'the')")
def not_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), Not(Term("the")))


@query("not_other_field", TOK + "SELECT DISTINCT doc_id FROM tok JOIN documents USING (doc_id) WHERE term = 'the' AND source <> 'src0'")
def not_other_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), And((Term("the"), Not(Term("src0", "source")))))


@query(
    "not_near",
    TOK
    + """SELECT a.doc_id, count(*) AS total_hits FROM (SELECT * FROM tok WHERE term = 'the') a
WHERE NOT EXISTS (SELECT 1 FROM tok b WHERE b.term = 'of' AND b.doc_id = a.doc_id AND b.pos < a.pos + 1 + 20 AND a.pos < b.pos + 1 + 20) GROUP BY a.doc_id""",
)
def not_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(documents_index(spark, sf_dir)).spans(And((Term("the"), Not(Term("of")))))).select("doc_id", "total_hits")


@query(
    "span_not",
    TOK + "SELECT a.doc_id, count(*) AS total_hits FROM (SELECT * FROM tok WHERE term = 'the') a WHERE NOT EXISTS (SELECT 1 FROM tok b WHERE b.term = 'of' AND b.doc_id = a.doc_id AND b.pos < a.pos + 3 AND a.pos < b.pos + 3) GROUP BY a.doc_id",
)
def span_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(documents_index(spark, sf_dir)).spans(SpanNot(Term("the"), Term("of"), 2))).select("doc_id", "total_hits")


# proximity


def pair_sql(cost: str, condition: str) -> str:
    return f"""{TOK}, {spans_sql("a", "of")}, {spans_sql("b", "the")},
p AS (SELECT a.doc_id, a.score + b.score AS pair_score, {cost} AS cost FROM a JOIN b ON a.doc_id = b.doc_id AND {condition})
{hits_sql("SELECT doc_id, pair_score / (cost + 1) AS score FROM p")}"""


UNORDERED = "CASE WHEN b.s >= a.e THEN b.s - a.e WHEN b.e <= a.s THEN a.s - b.e + 1 ELSE 0 END"


@query("phrase", pair_sql("0", "b.s = a.e"))
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), Near((Term("of"), Term("the")), 0, True))


@query("phrase_of_three", TOK + "SELECT a.doc_id, count(*) AS total_hits FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and' GROUP BY a.doc_id")
def phrase_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(documents_index(spark, sf_dir)).spans(Near((Term("of"), Term("the"), Term("and")), 0, True))).select("doc_id", "total_hits")


@query("near", pair_sql(UNORDERED, f"{UNORDERED} <= 5"))
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), Near((Term("of"), Term("the")), 5))


@query("near_ordered", pair_sql("b.s - a.e", "b.s >= a.e AND b.s - a.e <= 5"))
def near_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), Near((Term("of"), Term("the")), 5, True))


@query("and_as_proximity", pair_sql(UNORDERED, f"{UNORDERED} <= 20"))
def and_as_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), And((Term("of"), Term("the"))))


@query("or_near", TOK + "SELECT DISTINCT doc_id FROM tok WHERE term IN ('idiot', 'clown', 'moron')")
def or_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), OrNear((Term("idiot"), Term("clown"), Term("moron")), 10))


@query("or_near_scores")
def or_near_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), OrNear((Term("idiot"), Term("clown"), Term("moron")), 10))


@query("keyword_fields", TOK + "SELECT doc_id FROM (SELECT doc_id, term FROM tok UNION SELECT doc_id, lang FROM documents) WHERE term IN ('the', 'en') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def keyword_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), Keyword(("the", "en"), ("text", "lang")))


@query("best_spans")
def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near spans of which none overlaps another: the best of each clash."""
    return deduped(Compiler(documents_index(spark, sf_dir)).spans(Near((Term("of"), Term("the")), 5))).withColumn("score", F.round("score", 6))


# sections and sub-documents


@query(
    "section_type",
    r"SELECT doc_id, count(*) AS total_hits FROM (SELECT conv_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations WHERE role = 'user') WHERE term = 'the' GROUP BY doc_id",
)
def section_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(Compiler(conversations_index(spark, sf_dir)).spans(InSection(Term("the"), "user"))).select("doc_id", "total_hits")


@query(
    "sub_document_filter",
    r"SELECT doc_id, count(*) AS total_hits FROM (SELECT conv_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations WHERE turn = 1) WHERE term = 'the' GROUP BY doc_id",
)
def sub_document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = '<query><and><subDocument>1</subDocument><term field="text">the</term></and></query>'
    return hits(Compiler(conversations_index(spark, sf_dir)).spans(parse_xml.parse(source).query)).select("doc_id", "total_hits")


@query(
    "section_positions",
    r"""WITH t AS (SELECT conv_id AS doc_id, turn, role, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM conversations),
g AS (SELECT *, CASE WHEN lag(role) OVER w <> role THEN 20 ELSE 0 END AS gap FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
b AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY turn) - n AS begin_ FROM g)
SELECT doc_id, CAST(begin_ AS INTEGER) AS start, CAST(begin_ + n AS INTEGER) AS "end", role AS section_type FROM b WHERE n > 0""",
)
def section_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_index(spark, sf_dir).sections.drop("sub_document")


@query("sub_documents", "SELECT conv_id * 1000 + turn AS doc_id, conv_id AS parent_id, coalesce(role, (SELECT min(role) FROM conversations)) AS role, 'chat' AS kind FROM conversations")
def sub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("parent_id"), "role", F.lit(None).cast("string").alias("kind"))
    parents = parts.select(F.col("parent_id").alias("doc_id")).distinct().withColumn("kind", F.lit("chat"))
    return subdocuments.inherit(parts, parents, ["kind"]).select("doc_id", "parent_id", "role", "kind")


# ranking


@query("sort_empty_last", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, doc_id LIMIT 500")
def sort_empty_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "quality", F.lit(1.0).alias("score")).orderBy(*ranking.order_by(docs, "quality:descending")).limit(500).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("sort_empty_first", "SELECT doc_id, coalesce(quality, -1) AS quality, lang FROM documents LEFT JOIN labels l USING (doc_id) ORDER BY l.quality ASC NULLS FIRST, lang DESC NULLS LAST, doc_id LIMIT 300")
def sort_empty_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.orderBy(*ranking.order_by(docs, "quality:ascending:emptyFirst, -lang")).limit(300).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "lang")


@query(
    "page_with_fields",
    TOK + ", " + spans_sql("a", "the") + ", h AS (" + hits_sql("SELECT * FROM a") + ") SELECT doc_id, score, total_hits, lang FROM h JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20",
)
def page_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return ranking.page(found(index, Term("the")), index.documents, "", 20, 10, ("lang",)).select("doc_id", "score", "total_hits", "lang")


@query("sort_by_hits", TOK + "SELECT doc_id, count(*) AS total_hits FROM tok WHERE term = 'the' GROUP BY doc_id ORDER BY total_hits DESC, doc_id LIMIT 25")
def sort_by_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return ranking.page(found(index, Term("the")), index.documents, "-totalHits", 0, 25, ()).select("doc_id", "total_hits")


@query(
    "boost_table",
    TOK
    + ", "
    + spans_sql("a", "the")
    + """, h AS (SELECT doc_id, sqrt(sum(score)) AS score FROM a GROUP BY doc_id)
SELECT doc_id, round(score * pow(coalesce(quality, 0.5), 2.0), 6) AS score FROM h LEFT JOIN labels USING (doc_id) WHERE score * pow(coalesce(quality, 0.5), 2.0) > 0""",
)
def boost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(Compiler(documents_index(spark, sf_dir)).spans(Term("the")))
    boosts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("boost"))
    return ranking.boosted(own, own.select("doc_id", F.col("doc_id").alias("key")), boosts, 2.0, 0.5).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "normalised_scores",
    TOK + ", " + spans_sql("a", "the") + ", h AS (SELECT doc_id, sqrt(sum(score)) AS score FROM a GROUP BY doc_id) SELECT doc_id, round(score / (SELECT max(score) FROM h), 5) AS score FROM h",
)
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.normalised(hits(Compiler(documents_index(spark, sf_dir)).spans(Term("the")))).select("doc_id", F.round("score", 5).alias("score"))


@query(
    "explained_scores",
    TOK + ", " + spans_sql("a", "the") + "SELECT doc_id, round(sqrt(sum(score)), 6) AS value, round(sum(score), 6) AS sum_of_spans, count(*) AS spans, round(max(score), 6) AS best_span FROM a GROUP BY doc_id",
)
def explained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.explained(Compiler(documents_index(spark, sf_dir)).spans(Term("the")))
    return e.select("doc_id", F.round("explanation.value", 6).alias("value"), F.round("explanation.sum_of_spans", 6).alias("sum_of_spans"), "explanation.spans", F.round("explanation.best_span", 6).alias("best_span"))


# facets

PATHS = """paths AS (SELECT c_custkey AS doc_id, r_name || '::' || n_name AS value, round(c_acctbal, 2) AS score
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def customer_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    values = joined.select(F.col("c_custkey").alias("doc_id"), F.concat_ws("::", "r_name", "n_name").alias("value"))
    return joined.select(F.col("c_custkey").alias("doc_id"), F.round("c_acctbal", 2).alias("score")), values


COUNTED = f"""WITH {PATHS},
m AS (SELECT DISTINCT doc_id, score, array_to_string(string_split(value, '::')[1:i], '::') AS path FROM (SELECT *, unnest(range(1, len(string_split(value, '::')) + 1)) AS i FROM paths)),
c AS (SELECT path, array_to_string(string_split(path, '::')[1:len(string_split(path, '::')) - 1], '::') AS parent, CAST(len(string_split(path, '::')) AS INTEGER) AS depth, count(*) AS total_docs, max(score) AS max_score FROM m GROUP BY path)
"""


@query("facet_flat", "SELECT lang AS path, count(*) AS total_docs FROM documents GROUP BY lang")
def facet_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return facets.counts(docs.select("doc_id", F.lit(1.0).alias("score")), docs.select("doc_id", F.col("lang").alias("value"))).select("path", "total_docs")


@query("facet_hierarchy", COUNTED + "SELECT * FROM c")
def facet_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.counts(*customer_paths(spark, sf_dir))


def _ranked(order: str) -> str:
    return COUNTED + f"SELECT path, CAST(row_number() OVER (PARTITION BY parent ORDER BY {order}) - 1 AS INTEGER) AS rank, count(*) OVER (PARTITION BY parent) AS siblings FROM c"


for _sort, _order in (("totalDocs", "total_docs DESC, path, max_score DESC"), ("value", "path"), ("reverseValue", "path DESC"), ("maxDocScore", "max_score DESC, path")):

    def _facet_sorted(spark: SparkSession, sf_dir: str, sort: str = _sort) -> DataFrame:
        return facets.ranked_groups(facets.counts(*customer_paths(spark, sf_dir)), sort).select("path", "rank", "siblings")

    query(f"facet_by_{_sort}", _ranked(_order))(_facet_sorted)


@query("facet_with_empty", TOK + "SELECT lang AS path, count(t.doc_id) AS total_docs FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM tok WHERE term = 'loser') t USING (doc_id) GROUP BY lang")
def facet_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    own = hits(Compiler(index).spans(Term("loser")))
    return facets.counts(own, index.documents.select("doc_id", F.col("lang").alias("value")), True).select("path", "total_docs")


@query("facet_documents", f"WITH {PATHS} SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM paths WHERE starts_with(value, 'EUROPE') QUALIFY rank BETWEEN 3 AND 12")
def facet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.group_documents(*customer_paths(spark, sf_dir), "EUROPE", 3, 12).select("doc_id", "rank")


@query(
    "facet_page_documents",
    f"WITH {PATHS} SELECT 'EUROPE' AS path, doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM paths WHERE starts_with(value, 'EUROPE::') QUALIFY rank BETWEEN 2 AND 6 "
    "UNION ALL SELECT value, doc_id, CAST(row_number() OVER (PARTITION BY value ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM paths WHERE starts_with(value, 'ASIA::') QUALIFY rank <= 3",
)
def facet_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a selection asks for: those of one group from the second to the sixth, and the best three of each group below another."""
    own, values = customer_paths(spark, sf_dir)
    root = facets.tree(facets.counts(own, values), "totalDocs")
    facets.select(root, "EUROPE#2-6|ASIA::*#1-3")
    return facets.selected_documents(root, own, values).select("path", "doc_id", "rank")


def selected(spark: SparkSession, sf_dir: str, selector: str, sort: str = "totalDocs") -> DataFrame:
    root = facets.tree(facets.counts(*customer_paths(spark, sf_dir)), sort)
    facets.select(root, selector)
    return spark.createDataFrame(facets.result_rows(root), "path string, rank int, total_sub_groups int, total_docs long, selected boolean").where("selected").select("path", "total_docs")


@query("select_range", COUNTED + "SELECT path, total_docs FROM (SELECT *, row_number() OVER (ORDER BY total_docs DESC, path) AS r FROM c WHERE parent = 'ASIA') WHERE r BETWEEN 2 AND 4")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, "ASIA::*[2-4]")


@query("select_union_siblings", COUNTED + "SELECT path, total_docs FROM c WHERE path = 'AFRICA' OR parent = 'AFRICA' OR parent = ''")
def select_union_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, "AFRICA|AFRICA::*|AFRICA[siblings]")


@query("select_page", COUNTED + "SELECT path, total_docs FROM (SELECT *, row_number() OVER (ORDER BY path) AS r FROM c WHERE parent = 'EUROPE') WHERE r <= 3")
def select_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, "EUROPE::*[1][page(size=3)]", "value")


@query("select_top_choices", COUNTED + "SELECT path, total_docs FROM c WHERE parent = ''")
def select_top_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, "**[topChoices]")


@query("select_unselected", COUNTED + "SELECT path, total_docs FROM c WHERE depth = 1")
def select_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, "ASIA|*[unselected]")


# more like this, spelling


@query(
    "telling_words",
    TOK
    + """, own AS (SELECT term, count(*) AS tf FROM tok WHERE doc_id = (SELECT min(doc_id) FROM tok WHERE term = 'the') AND length(term) BETWEEN 4 AND 12 GROUP BY term),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term)
SELECT term, round(tf * (1 + ln((SELECT d FROM d) / (df + 1))), 6) AS weight FROM own JOIN df USING (term)
WHERE df BETWEEN 2 AND greatest(5, CAST(floor((SELECT d FROM d) / 20) AS BIGINT)) AND term NOT IN ('the','of','and','to','in','a','is','that','le','la','de','les','der','die','und','el','los','que')
ORDER BY weight DESC, term LIMIT 10""",
)
def telling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiler = Compiler(documents_index(spark, sf_dir))
    target = compiler.spans(Term("the")).agg(F.min("doc_id")).first()[0]
    return morelike.telling_words(compiler, MoreLike(Term("the")), target).select("term", F.round("weight", 6).alias("weight"))


@query("more_like_this")
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(documents_index(spark, sf_dir), MoreLike(Term("the"))).orderBy(F.desc("score"), "doc_id").limit(10)


STOPS_SQL = "('the','of','and','to','in','a','is','that','le','la','de','les','der','die','und','el','los','que')"


@query("spelling_words", TOK + f"SELECT term AS word, count(*) AS freq FROM tok WHERE term NOT IN {STOPS_SQL} GROUP BY term HAVING count(*) >= 2")
def spelling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.word_counts(text_postings(table(spark, sf_dir, "documents"), "text", "text"), STOP_WORDS)


@query(
    "spelling_pairs",
    TOK + f""", p AS (SELECT term AS first, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok WHERE term NOT IN {STOPS_SQL})
SELECT first, second, count(*) AS freq FROM p WHERE second IS NOT NULL GROUP BY first, second HAVING count(*) >= 2""",
)
def spelling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, STOP_WORDS)


def neighbours(spark: SparkSession, sf_dir: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of neighbours in the documents; rows of one id, if there are such, are one document."""
    docs = table(spark, sf_dir, "documents")
    if documents_index(spark, sf_dir).once:
        return spelling.text_pair_counts(docs, stop_words)
    return spelling.pair_counts(text_postings(docs, "text", "text"), stop_words)


@query("spelling_key_sizes", "WITH w AS (SELECT DISTINCT lower(p_brand) AS word FROM part), s AS (SELECT rpad(word[1:6], 6, ' ') AS p FROM w), k AS (SELECT unnest([p[1:1]||p[2:2]||p[3:3]||p[4:4], p[3:3]||p[4:4]||p[5:5]||p[6:6]]) AS key FROM s) SELECT key, count(*) AS words FROM k WHERE key IN (SELECT p[1:4] FROM s) GROUP BY key")
def spelling_key_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many brands share the key of their first four characters, or of the last four of six."""
    brands = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("word"), F.lit(2).alias("freq")).distinct()
    keys = spelling.spelling_keys(brands)
    head, tail = F.rpad(F.substring("word", 1, 4), 4, " "), F.substring(F.rpad(F.substring("word", 1, 6), 6, " "), 3, 4)
    both = keys.where(F.col("key") == head).select("key").unionAll(keys.where(F.col("key") == tail).select("key"))
    heads = brands.select(head.alias("key")).distinct()
    return both.join(heads, "key", "left_semi").groupBy("key").agg(F.count("*").alias("words"))


@query("spelling_suggestions")
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = text_postings(table(spark, sf_dir, "documents"), "text", "text")
    speller = spelling.Speller(store.written(spelling.word_counts(postings), "words"), neighbours(spark, sf_dir))
    tried = ("idoit", "wortless", "clonw", "patetic")
    return spark.createDataFrame(list(zip(tried, speller.suggest_words(tried))), "original string, suggestion string")


# snippets, works


@query("snippets_of_page")
def snippets_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    spans = Compiler(index).spans(Near((Term("of"), Term("the")), 2))
    page = [r.doc_id for r in hits(spans).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(10).collect()]
    of_page = lambda df: df.where(F.col("doc_id").isin(page))
    shown = hits(of_page(spans), True).join(of_page(index.documents).select("doc_id", "text"), "doc_id")
    return snippets.snippets(shown, ("of", "the"))


@query("works_of_parts")
def works_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return works.works(parts.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit("1999").alias("date"), F.lit(None).cast("string").alias("id")))


# lifecycle


@query("index_dump", TOK + "SELECT 'text' AS field, term, count(DISTINCT doc_id) AS doc_freq, count(*) AS freq FROM tok GROUP BY term UNION ALL SELECT 'lang', lang, count(*), count(*) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(*) FROM documents GROUP BY source")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dump_terms(documents_index(spark, sf_dir))


@query(
    "index_stats",
    TOK
    + """SELECT 'text' AS field, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words, (SELECT count(DISTINCT term) FROM tok) AS terms, CAST(sum(greatest(1, ceil((n - 20) / 180.0))) AS BIGINT) AS chunks FROM len
UNION ALL SELECT 'lang', count(*), count(*), count(DISTINCT lang), count(*) FROM documents UNION ALL SELECT 'source', count(*), count(*), count(DISTINCT source), count(*) FROM documents""",
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(documents_index(spark, sf_dir))


@query(
    "index_changes",
    """WITH o AS (SELECT doc_id AS key, n_chars AS dt FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id AS key, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS dt FROM documents WHERE lang <> 'es')
SELECT key, CASE WHEN n.dt IS NULL THEN 'gone' WHEN o.dt IS NULL THEN 'new' WHEN n.dt <> o.dt THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n USING (key)""",
)
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("file_date"), "lang")
    new = docs.where("lang <> 'es'").withColumn("file_date", F.when(F.col("lang") == "fr", F.col("file_date") + 1).otherwise(F.col("file_date")))
    return store.changes(docs.where("lang <> 'de'"), new)


@query("index_cull", TOK + "SELECT term, count(*) AS freq FROM tok JOIN labels USING (doc_id) WHERE term IN ('the', 'le', 'der', 'el') GROUP BY term")
def index_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    culled = store.cull(documents_index(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id").distinct())
    return culled.postings.where((F.col("field") == "text") & F.col("term").isin("the", "le", "der", "el")).groupBy("term").agg(F.count("*").alias("freq"))


@query("index_merge", TOK + "SELECT term, count(DISTINCT doc_id) AS doc_freq FROM tok WHERE term IN ('the', 'of', 'le', 'der') GROUP BY term")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    halves = [index_table(docs.where(c), "doc_id", ["text"], ["lang"]) for c in ("lang = 'en'", "lang <> 'en'")]
    merged = store.merge(*halves)
    return merged.dictionary("text").where(F.col("term").isin("the", "of", "le", "der")).select("term", F.col("df").alias("doc_freq"))


@query("index_clean", TOK + "SELECT count(*) AS postings FROM tok WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def index_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = documents_index(spark, sf_dir)
    broken = Index(whole.documents.where("lang = 'en'"), whole.values, whole.postings)
    return store.clean(broken).postings.where("field = 'text'").agg(F.count("*").alias("postings"))


@query("postings", TOK + "SELECT term, doc_id, CAST(pos AS INTEGER) AS pos FROM tok")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_postings(table(spark, sf_dir, "documents"), "text", "text").select("term", "doc_id", "pos")


@query("keyword_terms", "SELECT source AS term, count(*) AS n FROM documents GROUP BY source")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_postings(table(spark, sf_dir, "documents"), "source", "source").groupBy("term").agg(F.count("*").alias("n"))


# sources and functions


@query("html_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", formats.html_title(F.col("html")).alias("title"))


@query("html_texts")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.html_column(table(spark, sf_dir, "pages")).select("page_id", "title", F.md5("text").alias("text_md5"))


@query(
    "scalar_functions",
    """SELECT doc_id, md5(text) AS text_md5, CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS number,
CASE WHEN n_chars >= 1024 THEN format('{:.1f} KB', n_chars / 1024) ELSE n_chars || ' B' END AS size, 1999 AS year FROM documents""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5("text").alias("text_md5"), digits_as_number(F.col("source")).alias("number"), human_size(F.col("n_chars")).alias("size"), year(F.lit("v. 12, 1999 (c2001)")).alias("year"))


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumns({"total": F.round("total", 4), "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")})


@query("streamed_postings", TOK + "SELECT term, count(*) AS freq FROM tok GROUP BY term")
def streamed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, indexed batch by batch into the session's checkpoint folder."""
    import uuid

    path = f"{store.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/documents.parque[t]"  # as a pattern it may be a file or a folder
    ingest.start(spark, source, spark.read.parquet(source).schema, path).awaitTermination()
    return ingest.latest_postings(spark, path).groupBy("term").agg(F.count("*").alias("freq"))


# query languages


@query("xml_query", TOK + "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN documents d ON d.doc_id = a.doc_id WHERE a.term = 'of' AND b.term = 'the' AND d.source = 'src0'")
def xml_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = '<query maxDocs="all"><and><phrase field="text"><term>of</term><term>the</term></phrase><term field="source">src0</term></and></query>'
    return members(documents_index(spark, sf_dir), parse_xml.parse(source).query)


@query("freeform_query", TOK + "SELECT DISTINCT doc_id FROM tok WHERE term IN ('idiot', 'clown') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def freeform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = parse_text.freeform("idiot OR clown -source:src0")
    return members(documents_index(spark, sf_dir), rewrite.folded(node))


@query("cql_query", TOK + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM tok WHERE term IN ('idiot', 'loser')) AND lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'clown')")
def cql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents_index(spark, sf_dir), parse_text.cql('(text any "idiot loser" and lang = en) not clown'))


@query("parameter_query", TOK + "SELECT DISTINCT doc_id FROM tok JOIN documents USING (doc_id) WHERE term IN ('idiot', 'clown') AND lang = 'en' AND CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) BETWEEN 3 AND 9")
def parameter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = parse_text.parameters({"text": "idiot clown", "text-join": "or", "lang": "en", "source": "3", "source-max": "9"})
    return members(documents_index(spark, sf_dir), request.query)


@query("facet_filter", TOK + "SELECT DISTINCT doc_id FROM tok JOIN documents USING (doc_id) WHERE term = 'the' AND lang = 'en' AND source = 'src3'")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill-down: two facet values chosen beside a search."""
    return members(documents_index(spark, sf_dir), parse_text.parameters({"text": "the", "f1-lang": "en", "f2-source": "src3"}).query)


@query("facet_group_filter", f"WITH {PATHS} SELECT doc_id FROM paths WHERE starts_with(value, 'ASIA::')")
def facet_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of a hierarchy chosen: all that lies below it."""
    own, values = customer_paths(spark, sf_dir)
    index = Index(own, values.select(F.lit("place").alias("field"), "doc_id", F.lit(0).alias("ord"), "value"), keyword_postings(values, "place", "value"))
    return members(index, parse_text.parameters({"f1-place": "ASIA"}).query)


@query("stop_words_vanish", TOK + "SELECT DISTINCT doc_id FROM tok WHERE term = 'idiot'")
def stop_words_vanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = rewrite.without_stop_words(And((Term("the"), Term("idiot"), Term("of"))), frozenset(STOP_WORDS))
    return members(documents_index(spark, sf_dir), node)


# result projections


@query("record_list", "SELECT 'doc:' || doc_id AS identifier, strftime(ts, '%Y-%m-%d') AS datestamp, lang AS set_spec FROM (SELECT doc_id, lang, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS ts FROM documents) WHERE ts >= TIMESTAMP '2024-03-01' ORDER BY doc_id LIMIT 50")
def record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of harvested records: those changed since a date, in the order of ids."""
    docs = table(spark, sf_dir, "documents").withColumn("stamp", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")))
    return docs.where("stamp >= date '2024-03-01'").orderBy("doc_id").limit(50).select(F.concat(F.lit("doc:"), "doc_id").alias("identifier"), F.col("stamp").cast("string").alias("datestamp"), F.col("lang").alias("set_spec"))


@query("site_map", "SELECT 'https://library.example.org/view?id=' || doc_id AS loc, CASE WHEN quality = 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS priority FROM documents LEFT JOIN labels USING (doc_id)")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.concat(F.lit("https://library.example.org/view?id="), "doc_id").alias("loc"), F.when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("priority"))


@query("hits_as_json", TOK + "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"total_hits\":' || count(*) || '}' AS hit FROM tok WHERE term = 'idiot' GROUP BY doc_id")
def hits_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(Compiler(documents_index(spark, sf_dir)).spans(Term("idiot")))
    return own.select("doc_id", F.to_json(F.struct("doc_id", "total_hits")).alias("hit"))


@query("visible_documents", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access lists as a semi-join: what a reader's groups may see."""
    allowed = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return table(spark, sf_dir, "documents").join(allowed, "lang", "left_semi").select("doc_id")


@query("best_of_each_source", TOK + ", " + spans_sql("a", "the") + ", h AS (" + hits_sql("SELECT * FROM a") + ") SELECT source, doc_id, score FROM h JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
def best_of_each_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    rows = found(index, Term("the")).join(index.documents.select("doc_id", "source"), "doc_id")
    best = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("source", "doc_id", "score")
