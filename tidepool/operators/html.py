"""Web pages to Markdown: one small parser per page, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are left out with all that is in them, words of advertising and the like in classes and ids, and what a cut says.
DROPPED = (
    "script", "style", "noscript", "iframe", "svg", "path", "meta", "link", "header", "footer", "nav", "aside", "advertisement", "ads", "ad-container", "cookie-banner", "cookie-consent", "popup", "modal", "sidebar",
)
AD_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "popup", "modal", "cookie", "consent", "newsletter", "subscribe", "sidebar", "related", "recommended", "sponsored", "promo", "social-share", "share-buttons",
)
CUT = "\n\n[Content truncated due to length...]"
MOST = 75_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article table tr ul ol pre blockquote h1 h2 h3 h4 h5 h6 li br hr".split())
#: A word of advertising anywhere in a class or id ("shadow" has one), or, strictly, as a word of it.
ADS = re.compile("|".join(AD_WORDS), re.I)
STRICT_ADS = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(AD_WORDS)})(?![A-Za-z])", re.I)
HIDDEN = re.compile(r"display:\s*none", re.I)
WHOLE = ("http://", "https://", "mailto:", "#")


class _Page(HTMLParser):
    def __init__(self, base: str, strict: bool, markup: bool = False):
        super().__init__(convert_charrefs=not markup)
        self.base, self.ads, self.markup = base, STRICT_ADS if strict else ADS, markup
        self.out: list[str] = []
        self.skip: list[str] = []
        self.link: list[tuple[int, str]] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in DROPPED or HIDDEN.search(a.get("style", "")) or self.ads.search(a.get("class", "")) or self.ads.search(a.get("id", "")):
            if tag not in VOID:
                self.skip.append(tag)
            return
        if self.markup:
            self.out.append(self.get_starttag_text())
            return
        if tag in BLOCKS:
            self.out.append("\n" if tag in ("li", "tr", "br") else "\n\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")
        elif tag == "a":
            href = a.get("href", "")
            self.link.append((len(self.out), href if not href or href.startswith(WHOLE) else urljoin(self.base, href)))

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if self.markup:
            if tag not in VOID:
                self.out.append(f"</{tag}>")
        elif tag == "a" and self.link:
            at, href = self.link.pop()
            text = "".join(self.out[at:])
            self.out[at:] = [f"[{text}]({href})" if href and text.strip() else text.strip() and text]
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.markup else re.sub(r"\s+", " ", data))

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def markdown(html: str, base: str = "", strict: bool = False, most: int = MOST) -> str:
    """The page's text with headings, bullets and links resolved against its address; no images, comments, hidden or advertising parts.
    Beyond ``most`` characters it ends with a notice."""
    page = _Page(base, strict)
    page.feed(html)
    page.close()
    text = re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(page.out)))).strip()
    return text[:most] + CUT if len(text) > most else text


def cleaned(html: str, strict: bool = False) -> str:
    """The page's markup without comments, hidden or advertising parts, and what isn't content."""
    page = _Page("", strict, True)
    page.feed(html)
    page.close()
    return "".join(page.out)


def clean(pages: DataFrame, id: str, html: str, strict: bool = False) -> DataFrame:
    """(id, html) of pages, cleaned; null stays null."""

    @F.pandas_udf("string")
    def convert(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: None if h is None else cleaned(h, strict))

    return pages.select(id, convert(F.col(html)).alias("html"))


def to_markdown(pages: DataFrame, id: str, url: str, html: str, strict: bool = False) -> DataFrame:
    @F.pandas_udf("string")
    def convert(urls: pd.Series, htmls: pd.Series) -> pd.Series:
        return pd.Series([markdown(h or "", u or "", strict) for u, h in zip(urls, htmls, strict=True)])

    return pages.select(id, convert(F.col(url), F.col(html)).alias("markdown"))
