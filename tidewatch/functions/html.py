"""Pages read with the standard library's parser: metadata, JSON-LD, article text. Arrow batches of pages in, columns out."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SHORTEST_PARAGRAPH = 50
KINDS = StructType([StructField("title", StringType()), StructField("author", StringType()), StructField("heading", StringType()), StructField("meta", MapType(StringType(), StringType())), StructField("json_ld", ArrayType(StringType())), StructField("text", StringType())])


class _Page(HTMLParser):
    """One pass over a page: what is inside which element, with unclosed paragraphs ended by the next one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.meta: dict[str, str] = {}
        self.parts: dict[str, list[str]] = {"title": [], "h1": [], "author": [], "ld": []}
        self.paragraphs: list[list[str]] = []
        self.article: list[list[str]] = []
        self.ld, self.author_depth = False, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("property") or a.get("name")) and a.get("content") is not None:
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a["content"])
        if tag in VOID:
            return
        if tag == "p":
            self.paragraphs.append([])
            if "article" in self.open or "main" in self.open:
                self.article.append(self.paragraphs[-1])
        self.ld = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        if self.ld:
            self.parts["ld"].append("")
        self.open.append(tag)
        if a.get("rel") == "author" or "author" in (a.get("class") or "").split():
            self.author_depth = self.author_depth or len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                if last == tag:
                    break
        if len(self.open) < self.author_depth:
            self.author_depth = 0
        self.ld = self.ld and tag != "script"

    def handle_data(self, data):
        if self.ld:
            self.parts["ld"][-1] += data
            return
        if "script" in self.open or "style" in self.open:
            return
        for tag in ("title", "h1"):
            if tag in self.open:
                self.parts[tag].append(data)
        if self.author_depth:
            self.parts["author"].append(data)
        if "p" in self.open and self.paragraphs:
            self.paragraphs[-1].append(data)


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def read_page(html: str | None) -> tuple:
    """(title, author, heading, metadata, JSON-LD documents that parse, text). The title is OpenGraph's, else the element's; the
    text is that of paragraphs inside an article or main element, else of all paragraphs longer than SHORTEST_PARAGRAPH."""
    page = _Page()
    page.feed(html or "")
    page.close()
    found = []
    for text in page.parts["ld"]:
        try:
            found.append(json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True))
        except ValueError:
            continue
    own = [t for p in page.article if (t := _squeezed(p))]
    text = own or [t for p in page.paragraphs if len(t := _squeezed(p)) > SHORTEST_PARAGRAPH]
    title = page.meta.get("og:title") or page.meta.get("twitter:title") or _squeezed(page.parts["title"]) or None
    author = page.meta.get("author") or page.meta.get("article:author") or _squeezed(page.parts["author"]) or None
    return title, author, _squeezed(page.parts["h1"]) or None, page.meta, found, "\n\n".join(text)


@F.pandas_udf(KINDS)
def page_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=KINDS.names)
