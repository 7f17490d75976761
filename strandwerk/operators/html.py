"""HTML to structured text, over Arrow batches with a tolerant parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "body", "header", "footer", "blockquote", "pre"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}


class _Reader(HTMLParser):
    """Collects lines; remembers those inside the first main container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.all, self.main = "", [""], [""]
        self.skip, self.inside, self.depth, self.in_title = 0, 0, 0, False

    def _line(self, start: str = "") -> None:
        for out in (self.all, self.main) if self.inside else (self.all,):
            out.append(start)

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if tag not in _VOID:
            self.depth += 1
        a = dict(attrs)
        main = tag in ("article", "main") or a.get("role") == "main" or "content" in (a.get("class") or "").split() or a.get("id") == "content"
        if main and not self.inside and self.main == [""]:
            self.inside = self.depth
        if re.fullmatch("h[1-6]", tag):
            self._line("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._line("- ")
        elif tag in _BLOCK:
            self._line()

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        if self.inside and self.depth <= self.inside and tag not in _VOID:
            self.inside = 0
        if tag not in _VOID:
            self.depth = max(0, self.depth - 1)
        if tag in _BLOCK or tag == "li" or re.fullmatch("h[1-6]", tag):
            self._line()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            text = re.sub(r"\s+", " ", data)
            for out in (self.all, self.main) if self.inside else (self.all,):
                out[-1] += text if out[-1].strip(" #-") or text.strip() else ""


def html_text(html: str | None) -> str | None:
    """The readable text of a page: title line, headings as '#', items as '- '; a text without tags stays as it is."""
    if not html or "<" not in html:
        return html
    r = _Reader()
    r.feed(html)
    r.close()
    lines = [re.sub(r" +", " ", x).strip() for x in (r.main if any(x.strip() for x in r.main) else r.all)]
    lines = [x for x in lines if x.strip("#- ")]
    title = re.sub(r"\s+", " ", r.title).strip()
    return "\n".join([f"Title: {title}"] * bool(title) + lines)


def _texts(s: pd.Series) -> pd.Series:
    return s.map(html_text)


def html_to_text(c: Column) -> Column:
    """``html_text`` over a column, in Arrow batches."""
    return F.pandas_udf(_texts, StringType())(c)


def reduction_pct(before: Column, after: Column) -> Column:
    """By how many percent a text became shorter; 0 for an empty one."""
    n = F.length(before)
    return F.when(n > 0, F.round(100.0 * (n - F.length(after)) / n, 2)).otherwise(F.lit(0.0))
