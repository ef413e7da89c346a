"""The query algebra. Every node but Not, AllDocs and numeric ranges stands for spans of one field, or of several under Or and And."""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = 999_999_999


@dataclass(frozen=True)
class Node:
    """Base of all nodes; boost multiplies the node's scores."""


@dataclass(frozen=True)
class AllDocs(Node):
    boost: float = 1.0


@dataclass(frozen=True)
class Term(Node):
    text: str
    field: str = "text"
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Node):
    """A term with * and ?; expands to at most term_limit terms, more are an error."""

    pattern: str
    field: str = "text"
    boost: float = 1.0


@dataclass(frozen=True)
class Range(Node):
    """Terms between two bounds in code point order, or with numeric the digits of a field's value."""

    field: str
    lower: str | None = None
    upper: str | None = None
    inclusive: bool = True
    numeric: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Near(Node):
    """All children within `slop` words. phrase: slop 0, ordered; exact: also first to last of a field's value."""

    children: tuple[Node, ...]
    slop: int = ALL
    ordered: bool = False
    exact: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class OrNear(Node):
    """As many of the children as come close, extended from left to right."""

    children: tuple[Node, ...]
    slop: int = 10
    boost: float = 1.0


@dataclass(frozen=True)
class And(Node):
    """On one field proximity, unless switched off; across fields and for bare nots plain conjunction."""

    children: tuple[Node, ...]
    proximity: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class SpanFirst(Node):
    """Spans that end within the first `end` words."""

    child: Node
    end: int
    boost: float = 1.0


@dataclass(frozen=True)
class SpanNot(Node):
    """Spans of `include` that no span of `exclude` overlaps or comes nearer to than `slop`."""

    include: Node
    exclude: Node
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class InSection(Node):
    """Spans that lie in a section whose type, or whose sub-document, matches. kind: section_type or sub_document."""

    child: Node
    section_type: str
    boost: float = 1.0
    kind: str = "section_type"


@dataclass(frozen=True)
class InGroup(Node):
    """Documents in a facet's group: those with a value that is this path or lies below it."""

    field: str
    path: str
    boost: float = 1.0


@dataclass(frozen=True)
class Keyword(Node):
    """Words over several fields. With all, every word must be in some field; each field scores by how near they come."""

    words: tuple[str, ...]
    fields: tuple[str, ...]
    all_words: bool = True
    slop: int = 10
    boosts: tuple[float, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class MoreLike(Node):
    """Documents like the first one that the child finds."""

    child: Node
    fields: tuple[str, ...] = ("text",)
    boosts: tuple[float, ...] = ()
    most_terms: int = 10
    min_tf: int = 1
    min_df: int = 2
    max_df: int | None = None
    min_length: int = 4
    max_length: int = 12
    boost: float = 1.0


@dataclass(frozen=True)
class Facet:
    field: str
    select: str = "*"
    sort_groups: str = "totalDocs"
    sort_docs: str = ""
    include_empty: bool = False


@dataclass(frozen=True)
class Request:
    """A query with its envelope: paging, sorting, snippets, facets."""

    query: Node
    start: int = 0
    most: int = 10
    sort: str = ""
    return_fields: tuple[str, ...] | None = None
    normalize: bool = True
    explain: bool = False
    max_context: int = 80
    max_snippets: int = 3
    term_mode: str = "hits"
    term_limit: int = 50
    facets: tuple[Facet, ...] = ()
    spellcheck: dict = field(default_factory=dict)
    boost_set: dict = field(default_factory=dict)


class QueryError(ValueError):
    """A query that cannot be run as it is."""


def fields_of(node: Node) -> set[str]:
    if isinstance(node, Keyword):
        return set(node.fields)
    if isinstance(node, MoreLike):
        return set(node.fields)
    if hasattr(node, "field"):
        return {node.field}
    children = getattr(node, "children", None) or [getattr(node, n) for n in ("child", "include") if hasattr(node, n)]
    return set().union(*map(fields_of, children)) if children else set()
