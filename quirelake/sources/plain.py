"""Plain text, web and page-layout books as DataFrames; settings documents."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import basename, dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators.segmentation import _py, islands, plain_text_chapters

# ---------------------------------------------------------------- plain text

_CHAPTER = "array<struct<title:string,order_num:int,content:string,word_count:int>>"
BOOK = f"path string, title string, author string, language string, chapters {_CHAPTER}"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def plain_books(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per file with its chapters; malformed bytes become replacement characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"]):
                text = bytes(raw).decode("utf-8", "replace")
                title, author, made = plain_text_chapters(text)
                rows.append((p, title, author, [dict(title=t, order_num=i, content=c, word_count=len(c.split())) for i, (t, c) in enumerate(made)]))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "chapters"])

    out = files(spark, path, glob).mapInPandas(run, f"path string, title string, author string, chapters {_CHAPTER}")
    whole = F.array_join(F.transform("chapters", lambda c: c["content"]), "\n")
    return T.with_language(out.withColumn("_t", whole), "_t", "language").select("path", "title", "author", "language", "chapters")


def chapter_rows(books: DataFrame) -> DataFrame:
    """(path, title, order_num, section_type, content, word_count) of books read from files."""
    rows = books.select("path", F.explode("chapters").alias("c"))
    return rows.select("path", "c.title", "c.order_num", T.section_type("c.title").alias("section_type"), "c.content", "c.word_count")


# ---------------------------------------------------------------- web pages and web books

# Elements that begin and end a line, and elements without text.
_BLOCK = set("p div section article header footer li ul ol tr td th blockquote h1 h2 h3 h4 h5 h6 br hr".split())
_SILENT = {"script", "style"}


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text: list[str] = []
        self.silent = 0

    def _edge(self, tag: str, step: int) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent + step)
        elif tag in _BLOCK:
            self.text.append("\n")

    def handle_starttag(self, tag, attrs):
        self._edge(tag, 1)

    def handle_endtag(self, tag):
        self._edge(tag, -1)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def html_lines(html: str | None) -> list[str]:
    """The visible lines of a page, blanks squeezed, empty lines dropped."""
    p = _Lines()
    p.feed(html or "")
    p.close()
    return [s for x in "".join(p.text).replace("\xa0", " ").replace("\r", "\n").splitlines() if (s := " ".join(x.split()))]


def html_line_table(df: DataFrame, key: str, html: str) -> DataFrame:
    lines = F.pandas_udf(lambda s: s.map(html_lines), "array<string>")
    return df.select(key, F.posexplode(lines(html)).alias("pos", "line"))


_HEAD, _DIVIDER, _FRONT, _BACK, _COPY = map(_py, (P.EPUB_SECTION, P.DIVIDER, P.FRONT_MATTER, P.WEB_BACK_MATTER, P.WEB_COPYRIGHT))
_CH = re.compile(r"\bchapter\s+(?:\d+|[ivxlcdm]+|" + P.NUMBER_WORDS + r")\b", re.I)
_PROMO = _py(P.PROMOTION)


def is_heading(line: str) -> bool:
    return len(line) <= 160 and bool(_HEAD.match(line))


def is_contents(lines: list[str]) -> bool:
    text = "\n".join(lines)
    return bool(lines) and (bool(_FRONT.match(lines[0])) and "contents" in lines[0].lower() or "table of contents" in text.lower() and len(_CH.findall(text)) >= 3)


def to_skip(lines: list[str], begun: bool) -> bool:
    """Front and back matter, copyright pages, short pages before the story, appeals after its beginning."""
    text = "\n".join(lines)
    n = len(text.split())
    if not text or is_contents(lines) or _COPY.search(text) or _FRONT.match(lines[0]) or _BACK.match(lines[0]):
        return True
    if begun:
        return bool(_PROMO.search(text))
    return len(lines) <= 3 and n < 40 or n < 120 and not any(map(is_heading, lines))


def assemble(documents: list[tuple[list[str], str | None]]) -> list[tuple[str, str]]:
    """[(title, content)] of the documents of a web book in reading order, each with its title in the contents if it has one."""
    out: list[list[str]] = []
    late: list[list[str]] = []
    begun = ended = False

    def add(title: str, content: str, least: int | None = None) -> None:
        title, content = title.strip(), content.strip() or title.strip()
        if len(content.split()) >= (least if least is not None else 1 if _DIVIDER.match(title) else 40):
            out.append([title or f"Section {len(out) + 1}", content])

    def append(lines: list[str]) -> None:
        extra = "\n".join(lines).strip()
        if out and extra:
            out[-1][1] = (out[-1][1].rstrip() + "\n\n" + extra).strip()

    for lines, title in documents:
        if not lines or ended:
            continue
        if _BACK.match(lines[0]):
            ended = True
            continue
        if is_contents(lines) or not title and to_skip(lines, begun):
            continue
        at = [i for i, x in enumerate(lines) if is_heading(x)]
        if at:
            begun = True
            append(lines[: at[0]])
            for i, j in zip(at, [*at[1:], len(lines)]):
                add(lines[i], "\n".join(lines[i + 1 : j]))
        elif title:
            begun = True
            add(title, "\n".join(lines), 1)
        elif out and len(" ".join(lines).split()) < 300:
            append(lines)
        else:
            late.append(lines)
    for lines in late:
        add(next((x for x in lines[:5] if x and len(x) <= 120), f"Section {len(out) + 1}"), "\n".join(lines))
    return [(t, c) for t, c in out]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def open_web_book(raw: bytes) -> tuple[str, str, str, list[tuple[list[str], str | None]]]:
    """(title, author, language, documents) of a zipped web book."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    root = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
    pack, base = ElementTree.fromstring(z.read(root)), dirname(root)

    def first(name: str, other: str) -> str:
        return next((e.text.strip() for e in pack.iter() if _local(e.tag) == name and e.text and e.text.strip()), other)

    items = {e.attrib["id"]: e.attrib for e in pack.iter() if _local(e.tag) == "item"}
    titles: dict[str, str] = {}
    for a in items.values():
        href = normpath(join(base, unquote(a["href"])))
        if (a.get("media-type") == "application/x-dtbncx+xml" or "nav" in a.get("properties", "").split()) and href in z.namelist():
            tree = ElementTree.fromstring(z.read(href))
            for e in tree.iter():
                if _local(e.tag) == "navPoint":
                    label = next((x.text for x in e.iter() if _local(x.tag) == "text" and x.text), "")
                    src = next((x.attrib.get("src", "") for x in e.iter() if _local(x.tag) == "content"), "")
                elif _local(e.tag) == "a" and "href" in e.attrib:
                    label, src = "".join(e.itertext()), e.attrib["href"]
                else:
                    continue
                titles.setdefault(basename(unquote(src.partition("#")[0])), label.strip())
    docs = []
    for ref in (e.attrib.get("idref") for e in pack.iter() if _local(e.tag) == "itemref"):
        a = items.get(ref or "")
        name = normpath(join(base, unquote(a["href"]))) if a else ""
        if a and "nav" not in a.get("properties", "").split() and name in z.namelist():
            docs.append((html_lines(z.read(name).decode("utf-8", "replace")), titles.get(basename(name)) or None))
    return first("title", "Unknown Title"), first("creator", "Unknown"), first("language", "en")[:2].lower(), docs


def web_books(spark: SparkSession, path: str, glob: str = "*.epub") -> DataFrame:
    """One row per file; a file that can't be read has no chapters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"]):
                try:
                    title, author, lang, docs = open_web_book(bytes(raw))
                    made = assemble(docs)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    title, author, lang, made = "Unknown Title", "Unknown", "en", []
                rows.append((p, title, author, lang, [dict(title=t, order_num=i, content=c, word_count=len(c.split())) for i, (t, c) in enumerate(made)]))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "language", "chapters"])

    return files(spark, path, glob).mapInPandas(run, BOOK)


# ---------------------------------------------------------------- page layout: rows of line blocks


def join_spans(spans: str):
    """The text of array<struct<text,bbox,size>>: a blank only where the boxes leave a gap and no blank is there."""

    def step(acc, s):
        gap = F.try_element_at(s["bbox"], F.lit(1)) - F.try_element_at(acc["bbox"], F.lit(3))
        small = F.least(F.coalesce(acc["size"], F.lit(12.0)), F.coalesce(s["size"], F.lit(12.0)))
        open_ = (F.length(acc["text"]) > 0) & ~acc["text"].rlike("\\s$") & ~s["text"].rlike("^\\s")
        need = open_ & F.coalesce(gap > F.greatest(F.lit(1.0), small * 0.18), F.lit(False))
        return F.struct(F.concat(acc["text"], F.when(need, " ").otherwise(""), s["text"]).alias("text"), s["bbox"].alias("bbox"), s["size"].cast("double").alias("size"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("double").alias("size"))
    used = F.filter(spans, lambda s: F.coalesce(F.length(s["text"]), F.lit(0)) > 0)
    return F.trim(F.aggregate(used, start, step)["text"])


def without_page_numbers(blocks: DataFrame) -> DataFrame:
    """Drops lines of one to four digits that stand in the middle of the page; blocks have text, bbox, page_width."""
    middle = (F.try_element_at("bbox", F.lit(1)) + F.try_element_at("bbox", F.lit(3))) / 2
    centred = F.abs(middle - F.col("page_width") / 2) <= F.col("page_width") * 0.08
    return blocks.where(~(F.trim("text").rlike("^[0-9]{1,4}$") & F.coalesce(centred & (F.col("page_width") > 0), F.lit(False))))


def body_size(blocks: DataFrame, key: str) -> DataFrame:
    """(key, body): the commonest line size, the first seen of equals; 12 for none."""
    n = blocks.groupBy(key, F.round("size", 2).alias("s")).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return n.groupBy(key).agg(F.max_by("s", F.struct("n", (-F.col("p")).alias("p"))).alias("body"))


def layout_chapters(blocks: DataFrame, key: str, default_title: str) -> DataFrame:
    """(key, order_num, title, content): sections between headings, longer than 100 characters.

    With two explicit markers only they cut; else also lines larger than the body with a section word.
    """
    explicit = T.is_explicit_section("text")
    rows = blocks.join(body_size(blocks, key), key, "left")
    word = F.col("text").rlike(r"(?iu)\b(chapter|part|prologue|epilogue|foreword|preface|introduction|afterword|appendix|interlude|fejezet|rész)\b")
    large = (F.length("text") < 120) & (F.col("size") > F.coalesce("body", F.lit(12.0)) + 0.5) & word
    n = F.sum(explicit.cast("int")).over(Window.partitionBy(key))
    rows = islands(rows.withColumn("is_heading", explicit | ((n < 2) & large)), key)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "text")))), lambda x: x["text"]), " ")
    made = rows.groupBy(key, "island").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"), F.trim(body).alias("content")).where(F.length("content") > 100)
    order = F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1
    return made.select(key, order.alias("order_num"), F.coalesce("title", F.lit(default_title)).alias("title"), "content")


# ---------------------------------------------------------------- settings


def merged_settings(saved: str | None, defaults: dict) -> dict:
    """Saved values over defaults; a document that is no object changes nothing."""
    try:
        own = json.loads(saved or "{}")
    except ValueError:
        own = {}
    return {**defaults, **(own if isinstance(own, dict) else {})}


READERS = {"txt": plain_books, "epub": web_books}


def read_books(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; page layouts are read as line blocks")
    return READERS[kind](spark, path)


__all__ = ["assemble", "body_size", "chapter_rows", "html_line_table", "html_lines", "join_spans", "layout_chapters", "merged_settings", "plain_books", "read_books", "web_books", "without_page_numbers"]
