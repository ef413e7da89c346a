"""Facet counts over ragged hierarchies, and the language that selects groups."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.ast import QueryError

SEPARATOR = "::"
#: A facet's groups are brought to the driver for selection; more than this is an error, as no page could show them.
MOST_GROUPS = 200_000

ORDERS: dict[str, list[Column | str]] = {
    "totalDocs": ["-total_docs", "path", "-max_score"],
    "value": ["path", "-max_score", "-total_docs"],
    "reverseValue": ["-path", "-max_score", "-total_docs"],
    "maxDocScore": ["-max_score", "path", "-total_docs"],
}


def prefixes(value: Column) -> Column:
    """A::B::C to A, A::B and A::B::C."""
    parts = F.split(value, SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR))


def memberships(values: DataFrame) -> DataFrame:
    """Rows (doc_id, value) to (doc_id, path): a document is in each group of its values and in all above, once. An empty value is the group <empty>."""
    value = F.when(F.coalesce(F.col("value"), F.lit("")) == "", F.lit("<empty>")).otherwise(F.col("value"))
    return values.select("doc_id", F.explode(prefixes(value)).alias("path")).distinct()


def counts(hits: DataFrame, values: DataFrame, include_empty: bool = False) -> DataFrame:
    """Rows (path, parent, depth, total_docs, max_score) of the groups that the hits (doc_id, score) fall in."""
    members = memberships(values)
    found = members.join(hits.select("doc_id", "score"), "doc_id").groupBy("path").agg(F.count("*").alias("total_docs"), F.max("score").alias("max_score"))
    if include_empty:
        found = members.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("total_docs", F.lit(0)).alias("total_docs"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))
    depth = F.size(F.split("path", SEPARATOR))
    parent = F.when(depth > 1, F.array_join(F.slice(F.split("path", SEPARATOR), F.lit(1), depth - 1), SEPARATOR)).otherwise(F.lit(""))
    return found.select("path", parent.alias("parent"), depth.alias("depth"), "total_docs", "max_score")


def order_columns(sort: str) -> list[Column]:
    if sort not in ORDERS:
        raise QueryError(f"unknown group order: {sort}")
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[sort]]


def ranked_groups(counted: DataFrame, sort: str = "totalDocs") -> DataFrame:
    """Each group's rank among its siblings, from 0, and how many included siblings there are."""
    own = Window.partitionBy("parent").orderBy(*order_columns(sort))
    return counted.withColumns({"rank": F.row_number().over(own) - 1, "siblings": F.count("*").over(Window.partitionBy("parent"))})


def group_documents(hits: DataFrame, values: DataFrame, path: str, first: int = 1, last: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Documents first to last of one group, with their rank from 1."""
    own = hits.join(memberships(values).where(F.col("path") == path).select("doc_id"), "doc_id", "left_semi")
    rank = F.row_number().over(Window.orderBy(*(order or [F.desc("score"), F.asc("doc_id")])))
    bounded = own.orderBy(*(order or [F.desc("score"), F.asc("doc_id")])).limit(last) if last else own
    return bounded.withColumn("rank", rank).where(F.col("rank") >= first)


# selection, on the driver: groups are few


@dataclass
class Group:
    path: str
    name: str
    total_docs: int
    max_score: float
    parent: Group | None = None
    children: list[Group] = field(default_factory=list)
    rank: int = 0
    selected: bool = False
    marked: bool = False
    documents: tuple[int, int | None] | None = None

    def below(self) -> list[Group]:
        return [self, *[g for c in self.children for g in c.below()]]

    @property
    def depth(self) -> int:
        return 0 if self.parent is None else self.parent.depth + 1


def tree(counted: DataFrame, sort: str = "totalDocs") -> Group:
    """The groups under a root, siblings in their order. The root counts no documents itself."""
    rows = ranked_groups(counted, sort).orderBy("depth", "parent", "rank").limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise QueryError(f"a facet of more than {MOST_GROUPS} groups cannot be shown as a tree")
    root = Group("", "", 0, 0.0)
    known = {"": root}
    for r in rows:
        group = Group(r.path, r.path.split(SEPARATOR)[-1], r.total_docs, r.max_score, known[r.parent], rank=r["rank"])
        known[r.parent].children.append(group)
        known[r.path] = group
    return root


_PIECE = re.compile(r'\s*(?:(::)|(\|)|(\*\*)|(\*)|(\[[^\]]*\])|(#(?:all|\d+(?:-\d+)?))|"((?:[^"\\]|\\.)*)"|([^:\[\]|#"*\s](?:[^:\[\]|#"*]|:(?!:))*))')


def parse_selector(text: str) -> list[list[tuple[str, str]]]:
    """Arms of a union, each a list of steps (kind, argument)."""
    arms: list[list[tuple[str, str]]] = [[]]
    at = 0
    while at < len(text.rstrip()):
        match = _PIECE.match(text, at)
        if not match:
            raise QueryError(f"bad group selector at {text[at:]!r}")
        at = match.end()
        child, bar, all_below, all_, condition, docs, quoted, name = match.groups()
        if bar:
            arms.append([])
        elif all_below:
            arms[-1].append(("below", ""))
        elif all_:
            arms[-1].append(("children", ""))
        elif condition:
            arms[-1].append(("where", condition[1:-1].strip()))
        elif docs:
            arms[-1].append(("docs", docs[1:]))
        elif quoted is not None:
            arms[-1].append(("name", re.sub(r"\\(.)", r"\1", quoted)))
        elif name:
            arms[-1].append(("name", name.strip()))
    if any(not arm for arm in arms):
        raise QueryError("an arm of the group selector is empty")
    return arms


def select(root: Group, selector: str) -> list[Group]:
    """Mark the groups that the selector picks, arm after arm: each sees what those before have selected. Returns them in the order of the tree."""
    for arm in parse_selector(selector):
        found, documents = [root], None
        for kind, argument in arm:
            if kind == "name":
                found = [c for g in found for c in g.children if c.name == argument]
            elif kind == "children":
                found = [c for g in found for c in g.children]
            elif kind == "below":
                found = list({id(x): x for g in found for x in g.below()}.values())
            elif kind == "docs":
                first, _, last = argument.partition("-")
                documents = (1, None) if argument == "all" else (int(first), int(last) if last else None)
            else:
                found = _where(found, argument)
        for group in found:
            group.selected = True
            group.documents = documents or group.documents
            above = group.parent
            while above is not None:
                above.marked = True
                above = above.parent
    return [g for g in root.below() if g.selected]


def _where(found: list[Group], condition: str) -> list[Group]:
    if match := re.fullmatch(r"(\d+)(?:-(\d+))?", condition):
        first, last = int(match[1]), int(match[2] or match[1])
        return found[first - 1 : last]
    if match := re.fullmatch(r"page(?:\(size=(\d+)\))?", condition):
        return _pages(found, int(match[1] or 10))
    simple: dict[str, Callable[[Group], bool]] = {
        "empty": lambda g: g.total_docs == 0,
        "nonEmpty": lambda g: g.total_docs > 0,
        "selected": lambda g: g.selected,
        "unselected": lambda g: not g.selected,
    }
    if condition in simple:
        return [g for g in found if simple[condition](g)]
    if condition == "siblings":
        parents = list({id(g.parent): g.parent for g in found if g.parent}.values())
        return [c for p in parents for c in p.children]
    if condition == "topChoices":
        by: dict[int, list[Group]] = {}
        for g in found:
            if g.parent is not None:
                by.setdefault(id(g.parent), []).append(g)
        choices = [groups for groups in by.values() if len(groups) >= 2]
        return min(choices, key=lambda groups: groups[0].depth, default=[])
    if condition == "singleton":
        seen, made = set(), []
        for g in found:
            if g.parent is not None and id(g.parent) not in seen:
                seen.add(id(g.parent))
                if g.selected and len(g.parent.children) == 1:
                    made.append(g)
        return made
    raise QueryError(f"unknown group condition: [{condition}]")


def _pages(found: list[Group], size: int) -> list[Group]:
    made: dict[int, Group] = {}
    for g in found:
        if g.parent is not None:
            at = g.parent.children.index(g) // size * size
            made |= {id(c): c for c in g.parent.children[at : at + size]}
    return list(made.values())


def selected_documents(root: Group, hits: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (path, rank, and those of the hits) of the documents that a selection asks for with #: each group's own page of them."""
    made = hits.select(F.lit("").alias("path"), F.lit(0).alias("rank"), *hits.columns).limit(0)
    for g in root.below():
        if g.selected and g.documents:
            made = made.unionByName(group_documents(hits, values, g.path, *g.documents).select(F.lit(g.path).alias("path"), "rank", *hits.columns))
    return made


def result_rows(root: Group) -> list[tuple[str, int, int, int, bool]]:
    """(path, rank, total_sub_groups, total_docs, selected) of what is selected and all above it; totals count all included children."""
    return [(g.path, g.rank, len(g.children), g.total_docs, g.selected) for g in root.below() if g.selected or g.marked]


#: Facets computed by own code: name to a function (hits, arguments) -> rows (doc_id, value).
DYNAMIC: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def dynamic(name: str) -> Callable:
    def register(function: Callable[[DataFrame, str], DataFrame]) -> Callable:
        DYNAMIC[name] = function
        return function

    return register
