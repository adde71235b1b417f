"""Text of pages and fields that hold markup.

Tags and code are stripped by expressions in the JVM. Entities are undone in batches by an Arrow function (the JVM has
no built-in), which only sees rows that have an ampersand. JSON-LD needs recursion, so it is an Arrow function, too.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.constants import LOGIN_WORDS
from stellwerk.functions.jsontext import load
from stellwerk.functions.text import squeeze


@F.arrow_udf(T.StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([html_lib.unescape(x) if x is not None else None for x in text.to_pylist()], pa.string())


def strip_tags(markup: Column) -> Column:
    """Markup without code, styles and tags; entities stay."""
    no_code = F.regexp_replace(F.regexp_replace(markup, r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " ")
    return F.regexp_replace(no_code, r"<[^>]+>", " ")


def html_text(markup: Column) -> Column:
    """The text of markup, white space collapsed."""
    bare = strip_tags(markup)
    return squeeze(F.when(F.contains(bare, F.lit("&")), _unescape(bare)).otherwise(bare))


def readable_text(markup: Column, least: int = 80) -> Column:
    """As html_text, null below ``least`` characters: that is an empty shell."""
    text = html_text(markup)
    return F.when(F.length(text) >= least, text)


def login_wall(markup: Column) -> Column:
    """Whether a page asks for an account."""
    low = F.lower(markup)
    said = F.rlike(low, F.lit("|".join(map(re.escape, LOGIN_WORDS))))
    return said | F.rlike(markup, F.lit(r"(?i)<form\b[^>]*\baction\s*=\s*[\"'][^\"'>]*login"))


_LD = re.compile(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
JSONLD = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "company", "city", "date_posted", "description", "url")]))


def _one(value: object) -> object:
    return (value[0] if value else None) if isinstance(value, list) else value


def _postings(value: object) -> list[dict]:
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            if isinstance(x.get("@graph"), list):
                todo.extend(reversed(x["@graph"]))
                continue
            kinds = x.get("@type")
            if any(isinstance(k, str) and k.lower() == "jobposting" for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(x)
    return found


def _fields(posting: dict) -> dict[str, str | None]:
    organisation, location = _one(posting.get("hiringOrganization")), _one(posting.get("jobLocation"))
    address = _one(location.get("address")) if isinstance(location, dict) else None
    text = lambda v: v if isinstance(v, str) else None
    return {
        "title": text(posting.get("title")),
        "company": text(organisation.get("name")) if isinstance(organisation, dict) else None,
        "city": text(address.get("addressLocality")) if isinstance(address, dict) else None,
        "date_posted": (str(posting.get("datePosted") or ""))[:10] or None,
        "description": text(posting.get("description")),
        "url": text(posting.get("url")),
    }


def jsonld_of(markup: str | None) -> list[dict[str, str | None]]:
    """The job postings in a page's JSON-LD blocks; a block that is no JSON is skipped."""
    out = []
    for block in _LD.findall(markup or ""):
        try:
            out += [_fields(p) for p in _postings(load(block, str))]
        except ValueError:
            continue
    return out


@F.arrow_udf(JSONLD)
def jsonld_postings(markup: pa.Array) -> pa.Array:
    """``jsonld_of`` over a column."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "company", "city", "date_posted", "description", "url")]))
    return pa.array([jsonld_of(x) for x in markup.to_pylist()], kind)
