"""Phone numbers and mail addresses, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.constants import FILE_ENDINGS, FOREIGN_MAIL


#: What parts one number of a field from the next, and a note on a number.
_NEXT_NUMBER, _NOTE = r";|,|\b(?:oder|or)\b", r"\([^)]*\)"
#: Spellings of the two signs that addresses are written with against harvesters.
_AT, _DOT = r"(?i)\s*(?:\(|\[)\s*[aä]t\s*(?:\)|\])\s*", r"(?i)\s*(?:\(|\[)\s*(?:punkt|dot)\s*(?:\)|\])\s*"
_LINK, _ADDRESS = r"(?i)mailto:([^\s?>'\"]+)", r"[a-zA-Z0-9_.+-]+@(?:[a-zA-Z0-9_-]+\.)+[a-zA-Z0-9_-]+"


def phone(raw: Column, country: str = "+49") -> Column:
    """The first number of a field in E.164, or null where nothing can be dialled.

    Alternatives after ';', ',', 'or', 'oder' and notes in brackets are dropped; a number without leading zero or
    plus is no number; nine to fourteen digits count.
    """
    first = F.get(F.split(raw, _NEXT_NUMBER), F.lit(0))
    kept = F.regexp_replace(F.regexp_replace(first, _NOTE, ""), r"[^0-9+]+", "")
    full = F.when(F.startswith(kept, F.lit("00")), F.concat(F.lit("+"), F.substring(kept, 3, 99))).when(F.startswith(kept, F.lit("0")), F.concat(F.lit(country), F.substring(kept, 2, 99))).otherwise(kept)
    # A one-element array lets the expression stand once where its value is used twice.
    return F.get(F.filter(F.array(full), lambda n: F.rlike(n, F.lit(r"^\+\d{9,14}$"))), F.lit(0))


def _own(address: Column) -> Column:
    low = F.lower(address)
    foreign = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in FOREIGN_MAIL] + [F.endswith(low, F.lit(e)) for e in FILE_ENDINGS])
    return ~foreign & F.rlike(address, F.lit(r"@[^@]*\.[^@]*$"))


def email(html: Column) -> Column:
    """The business's own address on a page: from a mailto link first, else in the text, '(at)' and '(dot)' undone."""
    linked = F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(html, _AT, "@"), _DOT, ".")
    found = F.regexp_extract_all(plain, F.lit(_ADDRESS), F.lit(0))
    best = F.coalesce(F.get(F.filter(linked, _own), F.lit(0)), F.get(F.filter(found, _own), F.lit(0)))
    return F.when(F.rlike(best, F.lit(r"^\p{ASCII}*$")), F.lower(best)).otherwise(best)


def site_root(url: Column) -> Column:
    """Scheme and host of a site, https where none is given."""
    whole = F.when(F.rlike(url, F.lit(r"(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.try_parse_url(F.trim(whole), F.lit("HOST"))
    return F.when(F.length(host) > 0, F.concat(F.lower(F.try_parse_url(F.trim(whole), F.lit("PROTOCOL"))), F.lit("://"), host))
