"""Query nodes to DataFrames. Every node becomes spans: rows (doc_id, start, end, score).

Terms are resolved first: wildcards and ranges become terms, and document frequencies become literals. An index that
keeps postings takes those of new terms from the texts in the same pass. What is left is declarative: a scan of few terms, unions, and joins on the document and a
stretch of positions, so that a frequent word doesn't pair all its places in a document with all of another's.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import digits_as_number
from lectern.plans.ast import ALL, And, AllDocs, InGroup, InSection, Keyword, MoreLike, Near, Node, Not, Or, OrNear, QueryError, Range, SpanFirst, SpanNot, Term, Wildcard, fields_of
from lectern.plans.index import Index

SPAN = ("doc_id", "start", "end", "score")

#: Positions of a stretch, on which spans and sections are joined.
STRETCH = 256


def idf(df: int, docs: int) -> float:
    return 1 + math.log(docs / (df + 1)) if docs else 0.0


class Compiler:
    def __init__(self, index: Index, term_limit: int = 50):
        self.index, self.term_limit = index, term_limit
        self.frequency: dict[tuple[str, str], int] = {}

    # terms

    def resolve(self, node: Node) -> Node:
        """The node with wildcards and lexical ranges expanded, and all document frequencies fetched."""
        node = self._expand(node)
        wanted = {(n.field, n.text) for n in walk(node) if isinstance(n, Term)} | {(f, w) for n in walk(node) if isinstance(n, Keyword) for f in n.fields for w in n.words}
        wanted -= self.frequency.keys()
        if wanted and self.index.kept is not None:
            self.index.kept.keep(self.index, wanted)
            self.frequency |= {w: self.index.kept.frequency[w] for w in wanted}
        elif wanted:
            parts = [self.index.term_postings(name, [t for f, t in wanted if f == name]).withColumn("field", F.lit(name)) for name in sorted({f for f, _ in wanted})]
            found = reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.countDistinct("doc_id").alias("df"))
            self.frequency |= dict.fromkeys(wanted, 0) | {(r.field, r.term): r.df for r in found.collect()}
        return node

    def _expand(self, node: Node) -> Node:
        if isinstance(node, Wildcard):
            pattern = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in node.pattern) + "$"
            return self._terms(node, F.col("term").rlike(f"(?s){pattern}"), self.term_limit)
        if isinstance(node, Range) and not node.numeric:
            return self._terms(node, within(F.col("term"), node.lower, node.upper, node.inclusive), self.term_limit - 1)
        changes = {}
        for name in ("children", "child", "include", "exclude"):
            if hasattr(node, name):
                part = getattr(node, name)
                changes[name] = tuple(map(self._expand, part)) if name == "children" else self._expand(part)
        return replaced(node, **changes) if changes else node

    def _terms(self, node: Node, condition: Column, most: int) -> Node:
        found = self.index.postings.where((F.col("field") == node.field) & condition).select("term").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise QueryError(f"more than {most} terms match in field {node.field}")
        return Or(tuple(Term(r.term, node.field) for r in sorted(found, key=lambda r: r.term)), node.boost)

    # spans

    def spans(self, node: Node) -> DataFrame:
        node = self.resolve(node)
        return self._spans(node)

    def _spans(self, node: Node) -> DataFrame:
        make = getattr(self, f"_{type(node).__name__.lower()}", None)
        if make is None:
            raise QueryError(f"{type(node).__name__} stands alone only within other nodes")
        made = make(node)
        boost = getattr(node, "boost", 1.0)
        return made if boost == 1.0 else made.withColumn("score", F.col("score") * boost)

    def _alldocs(self, node: AllDocs) -> DataFrame:
        return self.index.documents.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("score"))

    def _term(self, node: Term) -> DataFrame:
        return self._all_terms([node])

    def _all_terms(self, terms: list[Term]) -> DataFrame:
        """Spans of several terms of one field in one scan; a term counts idf and the shortness of its field."""
        name = terms[0].field
        weights = {t.text: idf(self.frequency.get((name, t.text), 0), self.index.doc_count) * t.boost for t in terms}
        weight = F.lit(0.0)
        for text, w in weights.items():
            weight = F.when(F.col("term") == text, w).otherwise(weight)
        return self.index.sized_postings(name, list(weights)).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), (weight / F.sqrt("n")).alias("score"))

    def _range(self, node: Range) -> DataFrame:
        number = digits_as_number(F.col("value"))
        lower, upper = (None if b is None else int(re.sub("[^0-9]", "", b) or 0) for b in (node.lower, node.upper))
        found = self.index.values.where(F.col("field") == node.field).where(within(number, lower, upper, node.inclusive))
        return found.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("score")).distinct()

    def _or(self, node: Or) -> DataFrame:
        if not node.children:
            return self._alldocs(AllDocs()).where(F.lit(False))
        terms = [c for c in node.children if isinstance(c, Term)]
        rest = [c for c in node.children if not isinstance(c, Term)]
        parts = [self._all_terms([t for t in terms if t.field == f]) for f in dict.fromkeys(t.field for t in terms)]
        parts += [self._spans(c) for c in rest if not isinstance(c, Not)]
        parts += [self._lone_not(c) for c in rest if isinstance(c, Not)]
        united = reduce(DataFrame.unionByName, parts)
        return united if len(node.children) == 1 else united.groupBy("doc_id", "start", "end").agg(F.max("score").alias("score"))

    def _not(self, node: Not) -> DataFrame:
        return self._lone_not(node)

    def _lone_not(self, node: Not) -> DataFrame:
        return self._alldocs(AllDocs()).join(self._spans(node.child).select("doc_id").distinct(), "doc_id", "left_anti")

    def _and(self, node: And) -> DataFrame:
        wanted = [c for c in node.children if not isinstance(c, Not)]
        unwanted = [c.child for c in node.children if isinstance(c, Not)]
        names = set().union(*map(fields_of, wanted)) if wanted else set()
        if not wanted:
            found = self._alldocs(AllDocs())
        elif len(wanted) == 1:
            found = self._spans(wanted[0])
        elif node.proximity and len(names) == 1 and all(positional(c) for c in wanted):
            found = self._near(Near(tuple(wanted)))
        elif node.proximity and len(names) > 1 and all(positional(c) and len(fields_of(c)) == 1 for c in wanted):
            # the clauses of one field are a proximity of their own; fields meet by document
            groups = [tuple(c for c in wanted if fields_of(c) == {f}) for f in sorted(names)]
            found = self._meet([self._near(Near(g)) if len(g) > 1 else self._spans(g[0]) for g in groups])
        else:
            found = self._meet([self._spans(c) for c in wanted])
        for child in unwanted:
            if node.proximity and len(names) == 1 and fields_of(child) == names and positional(child) and all(map(positional, wanted)):
                found = self._not_near(found, self._spans(child), self._most_slop(names.copy().pop(), exclude=True))
            else:
                found = found.join(self._spans(child).select("doc_id").distinct(), "doc_id", "left_anti")
        return found

    @staticmethod
    def _meet(parts: list[DataFrame]) -> DataFrame:
        """All spans of documents that every part finds."""
        united = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
        whole = united.groupBy("doc_id").agg(F.countDistinct("_part").alias("_n")).where(F.col("_n") == len(parts))
        return united.join(whole, "doc_id", "left_semi").select(*SPAN)

    def _most_slop(self, name: str, exclude: bool = False) -> int:
        """On the full text proximity reaches no further than chunks overlap."""
        return self.index.overlap if name == "text" else ALL if exclude else 999_999

    def _near(self, node: Near) -> DataFrame:
        names = fields_of(node)
        if len(names) != 1:
            raise QueryError("proximity needs one field")
        if any(isinstance(c, (Not, AllDocs)) for c in node.children):
            raise QueryError("no not among near terms")
        slop = min(node.slop, self._most_slop(*names))
        first = self._spans(node.children[0])
        if node.exact:
            first = self._at_border(first, *names, "is_first")
        found = first.select("doc_id", F.col("start").alias("low"), F.col("end").alias("high"), F.col("start").alias("at"), F.col("end").alias("to"), "score", F.lit(0).alias("cost"))
        lengths = [longest(c) for c in node.children]
        for i, child in enumerate(node.children[1:], 1):
            right = self._spans(child)
            if node.exact and i == len(node.children) - 1:
                right = self._at_border(right, *names, "is_last")
            found = self._joined(found, right, slop, node.ordered, sum(lengths[: i + 1]))
        if node.exact and len(node.children) == 1:
            found = self._at_border(found.select("doc_id", F.col("low").alias("start"), F.col("high").alias("end"), "score"), *names, "is_last").select("doc_id", F.col("start").alias("low"), F.col("end").alias("high"), "score", F.lit(0).alias("cost"))
        return found.select("doc_id", F.col("low").alias("start"), F.col("high").alias("end"), (F.col("score") / (F.col("cost") + 1)).alias("score"))

    @staticmethod
    def _joined(found: DataFrame, right: DataFrame, slop: int, ordered: bool, length: int) -> DataFrame:
        """One more term within what is left of the slop; the join is on stretches of positions where the slop is short."""
        right = right.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("score").alias("r_score"))
        reach = slop + length + 1
        if reach < 10_000:
            found = found.withColumn("_stretch", F.floor(F.col("at") / reach))
            right = right.withColumn("_stretch", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("r_start") / reach) + d)))
            both = found.join(right.hint("merge"), ["doc_id", "_stretch"])  # kept postings are many times larger in memory than their files, by which a broadcast is chosen
        else:
            both = found.join(right, "doc_id")
        start, end, at, to = (F.col(c) for c in ("r_start", "r_end", "at", "to"))
        step = F.when(start >= to, start - to).when(end <= at, at - end + 1).otherwise(0)
        cost = F.col("cost") + step
        condition = (cost <= slop) & ((start >= to) if ordered and slop == 0 else (start > at) if ordered else ~((start == at) & (end == to)))
        return both.where(condition).select(
            "doc_id", F.least("low", start).alias("low"), F.greatest("high", end).alias("high"), start.alias("at"), end.alias("to"), (F.col("score") + F.col("r_score")).alias("score"), cost.alias("cost")
        )

    def _at_border(self, spans: DataFrame, name: str, border: str) -> DataFrame:
        edge = self.index.postings.where((F.col("field") == name) & F.col(border)).select("doc_id", F.col("pos").alias("_edge")).distinct()
        at = F.col("start") if border == "is_first" else F.col("end") - 1
        return spans.withColumn("_edge", at).join(edge, ["doc_id", "_edge"], "left_semi").drop("_edge")

    def _ornear(self, node: OrNear) -> DataFrame:
        """Greedy from left to right: a run grows by the next span of another term within the slop left; out of query order costs extra."""
        names = fields_of(node)
        slop = min(node.slop, self._most_slop(*names))
        each = reduce(DataFrame.unionByName, [self._spans(c).withColumn("term", F.lit(i)) for i, c in enumerate(node.children)])
        ordered = F.array_sort(F.collect_list(F.struct("start", "term", "end", "score")))
        return each.groupBy("doc_id").agg(ordered.alias("all")).select("doc_id", F.explode(_runs(F.col("all"), slop, len(node.children))).alias("r")).select("doc_id", "r.start", "r.end", "r.score")

    def _spanfirst(self, node: SpanFirst) -> DataFrame:
        return self._spans(node.child).where(F.col("end") <= node.end)

    def _spannot(self, node: SpanNot) -> DataFrame:
        return self._not_near(self._spans(node.include), self._spans(node.exclude), node.slop)

    @staticmethod
    def _not_near(include: DataFrame, exclude: DataFrame, slop: int) -> DataFrame:
        """Spans with no excluded one that overlaps or comes nearer than the slop."""
        stretch = max(STRETCH, 2 * min(slop, 1 << 20))
        reached = include.select("doc_id", "start", "end", _stretches(F.col("start") - slop, F.col("end") + slop, stretch))
        away = exclude.select("doc_id", F.col("start").alias("x_start"), F.col("end").alias("x_end"), _stretches(F.col("start"), F.col("end"), stretch))
        near = (F.col("x_start") < F.col("end") + slop) & (F.col("start") < F.col("x_end") + slop)
        met = reached.join(away, ["doc_id", "_stretch"]).where(near).select("doc_id", "start", "end").distinct()
        return include.join(met, ["doc_id", "start", "end"], "left_anti")

    def _insection(self, node: InSection) -> DataFrame:
        if self.index.sections is None:
            raise QueryError("the index has no sections")
        if node.kind not in self.index.sections.columns:
            raise QueryError(f"the index has no {node.kind}")
        there = self.index.sections.where(F.col(node.kind) == node.section_type).select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), _stretches(F.col("start"), F.col("end"), STRETCH))
        spans = self._spans(node.child).withColumn("_stretch", F.floor(F.col("start") / STRETCH))
        own = (spans.doc_id == there.doc_id) & (spans._stretch == there._stretch)
        return spans.join(there, own & (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end")), "left_semi").drop("_stretch")

    def _ingroup(self, node: InGroup) -> DataFrame:
        value = F.col("value")
        found = self.index.values.where((F.col("field") == node.field) & ((value == node.path) | value.startswith(node.path + "::")))
        return found.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("score")).distinct()

    def _keyword(self, node: Keyword) -> DataFrame:
        """Every field scores by the nearness of the words it has; with all_words a document must have each word somewhere."""
        boosts = node.boosts or (1.0,) * len(node.fields)
        scored = reduce(DataFrame.unionByName, [self._ornear(OrNear(tuple(Term(w, f) for w in node.words), node.slop)).withColumn("score", F.col("score") * b) for f, b in zip(node.fields, boosts)])
        if not node.all_words:
            return scored
        there = reduce(DataFrame.unionByName, [self.index.term_postings(f, node.words) for f in node.fields]).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))
        return scored.join(there.where(F.col("n") == len(set(node.words))), "doc_id", "left_semi")

    def _morelike(self, node: MoreLike) -> DataFrame:
        from lectern.operators.morelike import more_like

        return more_like(self, node)


def _stretches(start: Column, end: Column, size: int) -> Column:
    """The stretches of positions that a span touches, one row for each: what comes near shares one, so joins are on equal keys."""
    return F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(end - 1, start) / size))).alias("_stretch")


def _runs(spans: Column, slop: int, terms: int) -> Column:
    """Fold sorted spans into runs. State: finished runs and the open one, with the terms it has and its last span."""
    start = lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.score.alias("sum"), F.array(s.term).alias("has"), F.lit(0).alias("dist"))
    finished = lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), (r["sum"] * (F.size(r.has) / (terms + 1) + 1 / ((r.dist + 1) * (terms + 1)))).alias("score"))

    def step(state: Column, s: Column) -> Column:
        run = state.run
        gap = F.greatest(s.start - run.end, F.lit(0)) + F.when(F.element_at(run.has, -1) > s.term, 1).otherwise(0)
        grows = ~F.array_contains(run.has, s.term) & (run.dist + gap <= slop)
        grown = F.struct(run.start.alias("start"), F.greatest(run.end, s.end).alias("end"), (run["sum"] + s.score).alias("sum"), F.array_append(run.has, s.term).alias("has"), (run.dist + gap).cast("int").alias("dist"))
        return F.when(grows, F.struct(state.done.alias("done"), grown.alias("run"))).otherwise(F.struct(F.array_append(state.done, finished(run)).alias("done"), start(s).alias("run")))

    first = F.element_at(spans, 1)
    empty = F.array().cast("array<struct<start:int,end:int,score:double>>")
    rest = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0)))
    return F.aggregate(rest, F.struct(empty.alias("done"), start(first).alias("run")), step, lambda s: F.array_append(s.done, finished(s.run)))


def within(value: Column, lower: object, upper: object, inclusive: bool) -> Column:
    condition = value.isNotNull()
    if lower is not None:
        condition = condition & ((value >= lower) if inclusive else (value > lower))
    if upper is not None:
        condition = condition & ((value <= upper) if inclusive else (value < upper))
    return condition


def walk(node: Node) -> list[Node]:
    below = [*getattr(node, "children", ()), *[getattr(node, n) for n in ("child", "include", "exclude") if hasattr(node, n)]]
    return [node, *[x for child in below for x in walk(child)]]


def replaced(node: Node, **changes: object) -> Node:
    from dataclasses import replace

    return replace(node, **changes)


def positional(node: Node) -> bool:
    return not any(isinstance(n, (AllDocs, Not, MoreLike, Keyword, InGroup)) or (isinstance(n, Range) and n.numeric) for n in walk(node))


def longest(node: Node) -> int:
    """The most words that a span of this node has, without the slop between them."""
    below = [*getattr(node, "children", ())]
    if isinstance(node, (Near, And)):
        return sum(map(longest, below)) + min(getattr(node, "slop", ALL), 10_000)
    return max(map(longest, below), default=1)


def hits(spans: DataFrame, keep_spans: bool = False) -> DataFrame:
    """Rows (doc_id, score, total_hits): the root of the sum of a document's spans. With keep_spans also the spans by place."""
    more = [F.array_sort(F.collect_list(F.struct("start", "end", "score"))).alias("spans")] if keep_spans else []
    return spans.groupBy("doc_id").agg(F.sqrt(F.sum("score")).alias("score"), F.count("*").alias("total_hits"), *more)


def deduped(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the best one; ties go to the first by place. A document's spans are folded in the JVM."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "start", "end")))
    clash = lambda k, s: (k.start < s.end) & (s.start < k.end)
    kept = F.aggregate(order, F.slice(order, 1, 0), lambda a, s: F.when(F.exists(a, lambda k: clash(k, s)), a).otherwise(F.array_append(a, s)))
    return spans.groupBy("doc_id").agg(kept.alias("kept")).select("doc_id", F.explode("kept").alias("s")).select("doc_id", "s.start", "s.end", (-F.col("s.minus")).alias("score"))


def top(hit_rows: DataFrame, start: int, most: int) -> DataFrame:
    """A page by descending score, ties by id: a bounded sort, never a window over all hits."""
    return hit_rows.orderBy(F.desc("score"), "doc_id").limit(start + most).offset(start)


def ranked(page: DataFrame, start: int = 0) -> DataFrame:
    """Number the rows of a page, which is small."""
    return page.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) + start).cast("int"))
