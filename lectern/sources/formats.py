"""Files of several formats to rows of documents: XML, HTML, plain text and MARC."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = "path string, record_num int, title string, text string, meta map<string,array<string>>, error string"
_EXTENSIONS = (("XML", "xml|xhtml"), ("HTML", "html?|php"), ("Text", "txt|text|md"), ("MARC", "mrc|marc"), ("PDF", "pdf"), ("MSWord", "docx?"))


def format_of(path: Column) -> Column:
    """The format that a file's extension tells; null for none."""
    made = F.lit(None).cast("string")
    for name, pattern in _EXTENSIONS:
        made = F.when(F.lower(path).rlike(rf"\.({pattern})$"), name).otherwise(made)
    return made


class _Plain(HTMLParser):
    HIDDEN, BLOCKS = {"script", "style", "template", "noscript"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article", "header", "footer", "nav", "title"}

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.titles: list[str] = []
        self.meta: dict[str, list[str]] = {}
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in self.HIDDEN
        self.in_title = self.in_title or tag == "title"
        if tag in self.BLOCKS:
            self.parts.append("\n")
        if tag == "meta":
            named = dict(attrs)
            if named.get("name") and named.get("content"):
                self.meta.setdefault(named["name"], []).append(named["content"])

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag == "title":
            self.in_title = False
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles.append(data)
        elif not self.hidden:
            self.parts.append(data)


def html_text(source: str) -> tuple[str, str, dict[str, list[str]]]:
    """Title, text and named meta values of a page; scripts and styles don't count."""
    parser = _Plain()
    parser.feed(source)
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    return " ".join("".join(parser.titles).split()), "\n".join(line for line in lines if line), parser.meta


def xml_text(source: str, meta_names: frozenset[str] = frozenset({"title", "creator", "subject", "description", "date", "type", "identifier", "publisher", "language"})) -> tuple[str, str, dict[str, list[str]]]:
    """Title, text and metadata of an XML document: elements with a metadata name, or marked by an attribute called meta, are fields."""
    root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", source))
    meta: dict[str, list[str]] = {}

    def visit(element: ElementTree.Element, out: list[str]) -> None:
        name = element.tag.rpartition("}")[2]
        marked = any(k.rpartition("}")[2] == "meta" and v in ("yes", "true", "1") for k, v in element.attrib.items())
        inside: list[str] = [element.text or ""]
        for child in element:
            visit(child, inside)
            inside.append(child.tail or "")
        value = "".join(inside)
        if marked or (name.lower() in meta_names and len(element) == 0):
            meta.setdefault(name.lower(), []).append(" ".join(value.split()))
        else:
            out += [" ", value, " "]

    body: list[str] = []
    visit(root, body)
    return (meta.get("title") or [""])[0], " ".join("".join(body).split()), meta


def xml_head(source: str, name: str) -> str | None:
    """A large document's first element of this name, read no further than its end."""
    found = re.search(rf"<{re.escape(name)}\b[^>]*?(?:/>|>.*?</{re.escape(name)}\s*>)", source, re.DOTALL)
    return found.group() if found else None


def marc_records(data: bytes) -> Iterator[dict[str, list[str]]]:
    """Records of a MARC file: tag, and tag with subfield code, to values."""
    for record in data.split(b"\x1d"):
        if len(record) < 25:
            continue
        base = int(record[12:17])
        fields: dict[str, list[str]] = {}
        for at in range(24, base - 1, 12):
            entry = record[at : at + 12]
            if len(entry) < 12 or entry[:1] == b"\x1e":
                break
            tag, length, start = entry[:3].decode(), int(entry[3:7]), int(entry[7:12])
            raw = record[base + start : base + start + length].rstrip(b"\x1e").decode("utf-8", "replace")
            if tag < "010":
                fields.setdefault(tag, []).append(raw)
                continue
            subfields = [s for s in raw.split("\x1f")[1:] if s]
            fields.setdefault(tag, []).append(" ".join(s[1:].strip() for s in subfields))
            for s in subfields:
                fields.setdefault(tag + s[0], []).append(s[1:].strip())
        yield fields


def parse_file(path: str, kind: str, content: bytes) -> list[tuple]:
    """Rows of PARSED; a record that can't be read becomes a row with an error and spoils no other."""
    try:
        if kind == "MARC":
            return [(path, n, (f.get("245") or [""])[0], " ".join(v for k, vs in f.items() if len(k) == 3 and k >= "010" for v in vs), f, None) for n, f in enumerate(marc_records(content), 1)]
        text = content.decode("utf-8", "replace")
        if kind == "XML":
            return [(path, 0, *xml_text(text), None)]
        if kind == "HTML":
            return [(path, 0, *html_text(text), None)]
        if kind == "Text":
            return [(path, 0, "", text, {}, None)]
        return [(path, 0, None, None, {}, f"no reader for {kind}")]
    except Exception as e:  # noqa: BLE001
        return [(path, 0, None, None, {}, f"{type(e).__name__}: {e}")]


def read_tree(spark: SparkSession, path: str, rules: dict[str, str] | None = None) -> DataFrame:
    """All files below a folder, by format. rules: a pattern for paths to a format, before the extensions; "skip" leaves files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = format_of(F.col("path"))
    for pattern, name in reversed((rules or {}).items()):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    chosen = files.withColumn("kind", kind).where("kind is not null and kind <> 'skip'").select("path", "kind", "content", "modificationTime", "length")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for p, k, c in zip(batch["path"], batch["kind"], batch["content"]) for row in parse_file(p, k, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "record_num", "title", "text", "meta", "error"])

    parsed = chosen.select("path", "kind", "content").mapInPandas(parse, PARSED)
    return parsed.join(chosen.select("path", "kind", F.col("modificationTime").alias("file_date"), "length"), "path")


def html_column(df: DataFrame, source: str = "html") -> DataFrame:
    """Add title and text of pages kept in a column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("title string, text string")
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_text(p or "")[:2] for p in pages], columns=["title", "text"])

    return df.withColumn("_page", parse(F.col(source))).withColumns({"title": F.col("_page.title"), "text": F.col("_page.text")}).drop("_page")


def html_title(source: Column) -> Column:
    """A page's title, by Spark's functions alone."""
    return F.trim(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1))


def unescape(text: str) -> str:
    return html.unescape(text)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
