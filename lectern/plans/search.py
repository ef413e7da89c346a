"""A whole request: rewrites, hits, page, facets, snippets and suggestions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import facets, ranking, snippets
from lectern.operators.spelling import Speller
from lectern.plans import parse_xml, rewrite
from lectern.plans.ast import ALL, Keyword, Node, Not, QueryError, Request, Term
from lectern.plans.compile import Compiler, deduped, walk
from lectern.plans.index import Index


@dataclass
class Result:
    total_docs: int
    start: int
    page: DataFrame
    snippets: DataFrame | None = None
    facets: dict[str, list[tuple[str, int, int, int, bool]]] = field(default_factory=dict)
    suggestions: dict[str, str] = field(default_factory=dict)
    terms: tuple[str, ...] = ()


def prepared(index: Index, node: Node, plurals: Mapping[str, str] | None = None, accents: bool = False) -> Node | None:
    """The query as the index counts words; None if nothing but stop words is left."""
    node = rewrite.folded(node, accents, plurals)
    return None if node is None else rewrite.without_stop_words(rewrite.flattened(node), index.stop_words)


def search(index: Index, request: Request | str, boosts: Mapping[str, DataFrame] | None = None, speller: Speller | None = None, plurals: Mapping[str, str] | None = None, accents: bool = False) -> Result:
    """Answer a request, or its XML. Hits are kept once and feed page, facets and snippets; only a page's documents are looked at closely.

    boosts: names of boost sets to tables (key, boost).
    """
    if isinstance(request, str):
        request = parse_xml.parse(request)
    node = prepared(index, request.query, plurals, accents)
    empty = index.documents.where(F.lit(False))
    if node is None:
        return Result(0, request.start, empty)
    compiler = Compiler(index, request.term_limit)
    resolved = compiler.resolve(node)
    spans = compiler.spans(resolved)
    kept = deduped(spans)
    total_hits = kept.groupBy("doc_id").agg(F.count("*").alias("total_hits"))
    own = spans.groupBy("doc_id").agg(F.sqrt(F.sum("score")).alias("score")).join(total_hits, "doc_id")
    if request.boost_set:
        name, column = request.boost_set["boostSet"], request.boost_set["boostSetField"]
        if name not in (boosts or {}):
            raise QueryError(f"unknown boost set: {name}")
        keys = index.documents.select("doc_id", F.col(column).cast("string").alias("key"))
        own = ranking.boosted(own, keys, boosts[name], float(request.boost_set.get("boostSetExponent", 1)), float(request.boost_set.get("boostSetDefault", 1)))
    own = own.where("score > 0").persist()
    totals = own.agg(F.count("*").alias("n"), F.max("score").alias("best")).first()
    scored = own.withColumn("score", F.col("score") / F.lit(totals.best)) if request.normalize and totals.best else own
    page = ranking.page(scored, index.documents, request.sort, request.start, 1 << 30 if request.most >= ALL else request.most, request.return_fields)
    if request.explain:
        page = page.join(ranking.explained(spans), "doc_id", "left")
    result = Result(totals.n, request.start, page, terms=tuple(sorted({n.text for n in walk(resolved) if isinstance(n, Term)} | {w for n in walk(resolved) if isinstance(n, Keyword) for w in n.words})))
    for facet in request.facets:
        result.facets[facet.field] = facet_rows(index, own, facet)
    if request.max_snippets and "text" in index.documents.columns:
        ids = page.select("doc_id")
        chosen = kept.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("spans"))
        shown = chosen.join(index.documents.select("doc_id", "text"), "doc_id")
        result.snippets = snippets.snippets(shown, result.terms, min(request.max_snippets, 1_000_000), request.max_context, tuple(index.stop_words), request.term_mode)
    if speller is not None and wants_suggestions(request, totals.n, totals.best):
        result.suggestions = suggestions(index, request, node, totals, speller)
    return result


def facet_rows(index: Index, hits: DataFrame, facet) -> list[tuple[str, int, int, int, bool]]:
    """Selected groups of a facet, with those above them. A field written java:name(arguments) or call:name(arguments) is computed by own code."""
    kind, colon, rest = facet.field.partition(":")
    if colon and kind in ("java", "call"):
        name, _, arguments = rest.partition("(")
        if name not in facets.DYNAMIC:
            raise QueryError(f"unknown facet function: {name}")
        values = facets.DYNAMIC[name](hits, arguments.rstrip(")"))
    else:
        values = index.documents.select("doc_id", F.col(facet.field).cast("string").alias("value"))
    root = facets.tree(facets.counts(hits, values, facet.include_empty), facet.sort_groups)
    facets.select(root, facet.select)
    return facets.result_rows(root)


def wants_suggestions(request: Request, total: int, best: float | None) -> bool:
    cut = request.spellcheck
    return bool(cut) and total <= int(cut.get("totalDocsCutoff", 10)) and (best or 0.0) <= float(cut.get("docScoreCutoff", ALL))


def suggestions(index: Index, request: Request, node: Node, totals, speller: Speller) -> dict[str, str]:
    """Corrections of the query's plain words, if the corrected query finds more documents, or as many that score better."""
    out: set[str] = set()
    for n in walk(node):
        if isinstance(n, Not):
            out |= {t.text for t in walk(n) if isinstance(t, Term)}
    words = [n.text for n in walk(node) if isinstance(n, Term) and n.field == "text" and n.boost and n.text not in out]
    made = {w: s for w, s in zip(words, speller.suggest(words)) if s is not None} if words else {}
    better = rewrite.corrected(node, made) if made else None
    if better is None:
        return {}
    spans = Compiler(index, request.term_limit).spans(better)
    found = spans.groupBy("doc_id").agg(F.sqrt(F.sum("score")).alias("score")).agg(F.count("*").alias("n"), F.max("score").alias("best")).first()
    if not found.n or found.n < totals.n or (found.n == totals.n and (found.best or 0) < (totals.best or 0)):
        return {}
    return made


def view(index: Index, doc_id: int, query: Node | None = None) -> str:
    """One document's whole text with the hits of a query marked and numbered."""
    import regex

    from lectern.functions.text import WORD

    row = index.documents.where(F.col("doc_id") == doc_id).select("text").first()
    if row is None:
        raise QueryError(f"no document {doc_id}")
    if query is None:
        return row.text or ""
    found = deduped(Compiler(index).spans(query).where(F.col("doc_id") == doc_id)).collect()
    return snippets.mark_document(row.text or "", [(r.start, r.end, r.score) for r in found], regex.compile(WORD))
