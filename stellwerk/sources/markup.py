"""Lists of HTML job sites: anchors and cards, read by a streaming parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.functions.text import postcode_and_city, type_signals

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: How a site's links name a posting: source code, pattern of the address, whether an id counts once per page.
SITES = {
    "XI": (re.compile(r"^/jobs/(?P<id>[\w-]+)$"), False),
    "SS": (re.compile(r"^/stellenangebote--.*?(?P<id>\d+)-inline\.html"), False),
    "ID": (re.compile(r"[?&]jk=(?P<id>[0-9a-f]+)"), True),
}


class _Anchors(HTMLParser):
    """Collects (href, label, text) of anchors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self._open: tuple[str, str | None, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self._close()
            a = dict(attrs)
            if a.get("href"):
                self._open = (a["href"], a.get("aria-label"), [])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._close()

    def handle_data(self, data: str) -> None:
        if self._open:
            self._open[2].append(data)

    def _close(self) -> None:
        if self._open:
            href, label, parts = self._open
            text = label or " ".join(" ".join(parts).split())
            if text:
                self.found.append((href, text))
            self._open = None


def anchors(markup: str | None) -> list[tuple[str, str]]:
    """(href, title) of a page's links that have one."""
    p = _Anchors()
    p.feed(markup or "")
    p.close()
    p._close()
    return p.found


def linked(markup: str | None, site: str) -> list[tuple[str, str, str]]:
    """(source_id, title, href) of a page's links to postings."""
    pattern, once = SITES[site]
    seen: set[str] = set()
    out = []
    for href, title in anchors(markup):
        if (m := pattern.search(href)) and not (once and m["id"] in seen):
            seen.add(m["id"])
            out.append((m["id"], title, href))
    return out


class _Cards(HTMLParser):
    """Collects the ad cards of a classifieds page: attributes, and texts by the class they stand in."""

    PARTS = {"ellipsis": "title", "aditem-main--top--left": "place", "aditem-main--middle--description": "teaser"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict[str, str]] = []
        self.next_page: str | None = None
        self._stack: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "article" and "aditem" in classes:
            self.cards.append({"id": a.get("data-adid", ""), "href": a.get("data-href", "")})
        if tag == "a" and "pagination-next" in classes:
            self.next_page = a.get("href")
        if tag not in VOID:
            self._stack.append(next((self.PARTS[c] for c in classes if c in self.PARTS), None))

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and self._stack:
            self._stack.pop()

    def handle_data(self, data: str) -> None:
        part = next((p for p in reversed(self._stack) if p), None)
        if part and self.cards and data.strip():
            card = self.cards[-1]
            card[part] = " ".join([*card.get(part, "").split(), *data.split()])


def cards(markup: str | None) -> tuple[list[dict[str, str]], str | None]:
    """Offers on a classifieds page, and the next page's address."""
    p = _Cards()
    p.feed(markup or "")
    p.close()
    return [c for c in p.cards if c["id"] and c["href"] and c.get("title") and "/s-gesuch/" not in c["href"]], p.next_page


def link_postings(pages: DataFrame, site: str, base: str, markup: str = "html") -> DataFrame:
    """Postings that the list pages of a site link to: title, address, and what the title tells of the type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for t in b.column(0) for x in linked(t.as_py(), site)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["source_id", "title", "href"])

    found = pages.select(markup).mapInArrow(run, "source_id string, title string, href string").withColumn("said", type_signals(F.col("title")))
    return found.select(F.concat(F.lit(site + ":"), "source_id").alias("job_id"), F.lit(site).alias("source"), "source_id", "title", F.concat(F.lit(base), "href").alias("source_url"), *[F.array_contains("said", k).alias(f"is_{k}") for k in ("minijob", "werkstudent", "parttime", "fulltime", "internship")])


def card_postings(pages: DataFrame, base: str, markup: str = "html") -> DataFrame:
    """Postings of a classifieds site's list pages; the teaser informs the flags and is not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [c for t in b.column(0) for c in cards(t.as_py())[0]]
            names = ["id", "href", "title", "place", "teaser"]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.string()) for n in names], names=names)

    found = pages.select(markup).mapInArrow(run, "id string, href string, title string, place string, teaser string").withColumn("said", type_signals(F.col("title"), F.col("teaser"))).withColumn("at", postcode_and_city(F.col("place")))
    return found.select(F.concat(F.lit("KA:"), "id").alias("job_id"), F.lit("KA").alias("source"), F.col("id").alias("source_id"), "title", "at.plz", "at.city", F.concat(F.lit(base), "href").alias("source_url"), *[F.array_contains("said", k).alias(f"is_{k}") for k in ("minijob", "werkstudent", "parttime", "fulltime", "internship")])
