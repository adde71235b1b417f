"""Text folding, identity keys and wording signals as Column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stellwerk.constants import GERMAN_WORDS, GERMAN_WORDS_NEEDED, LEVELS, TYPE_WORDS

_MARKER = r"(?i)\(\s*[mwdf](?:\s*/\s*[mwdf])*\s*\)"
_SPELT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def spell(text: Column) -> Column:
    """Lower-case umlauts spelt out; capitals stay as they are."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _SPELT.items(), text)


def casefold(text: Column) -> Column:
    """Lower case with ß as ss: what caseless comparison of German needs."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """Every run of white space, the non-breaking kinds too, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def identity_text(text: Column) -> Column:
    """The part of an identity that a title or a company is; '' for null."""
    return casefold(squeeze(spell(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKER, ""))))


def identity_city(city: Column) -> Column:
    """The same for a town, whose text counts up to the first comma."""
    return identity_text(F.split_part(F.coalesce(city, F.lit("")), F.lit(","), F.lit(1)))


def dedupe_key(title: Column, company: Column, city: Column) -> Column:
    """One key for one ad, whichever source lists it."""
    return F.sha1(F.concat_ws("|", identity_text(title), identity_text(company), identity_city(city)))


def non_blank(text: Column) -> Column:
    """Whether a text has more than blanks; false for null."""
    return F.coalesce(F.length(squeeze(text)) > 0, F.lit(False))


def content_hash(text: Column) -> Column:
    """Digest of a text, null if it is blank."""
    return F.when(non_blank(text), F.sha1(text))


def slug(text: Column) -> Column:
    """As boards write a town or keyword in an address."""
    dashed = F.regexp_replace(spell(F.lower(squeeze(text))), " ", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def type_signals(*texts: Column) -> Column:
    """The employment types that texts tell, as an array in the order of the vocabulary."""
    said = casefold(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    found = lambda x: F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]), F.lit(kind)) for kind, words in TYPE_WORDS.items()])
    # A one-element array binds the folded text, which else would be folded anew for each word.
    return F.filter(F.flatten(F.transform(F.array(said), found)), lambda x: x.isNotNull())


def reads_as_german(text: Column) -> Column:
    """Whether a text has three different German function words."""
    words = F.transform(F.split(squeeze(text), " "), lambda w: casefold(F.btrim(w, F.lit(".,;:!?()[]\"'"))))
    return F.coalesce(F.size(F.array_intersect(words, F.array(*map(F.lit, GERMAN_WORDS)))) >= GERMAN_WORDS_NEEDED, F.lit(False))


def spellings_of_city(name: Column) -> Column:
    """A town's name in lower case, with umlauts spelt out, and with them bare."""
    low = F.lower(name)
    return F.array_distinct(F.array(low, spell(low), F.translate(low, "üöäß", "uoas")))


def postcode_and_city(text: Column) -> Column:
    """``struct(plz, city)`` of texts such as '85053 Ingolstadt'."""
    clean = squeeze(text)
    code = F.regexp_extract(clean, r"^(\d{5})\s+", 1)
    city = F.when(code != "", F.regexp_replace(clean, r"^\d{5}\s+", "")).otherwise(clean)
    return F.struct(F.nullif(code, F.lit("")).alias("plz"), F.nullif(city, F.lit("")).alias("city"))


def level_rank(level: Column) -> Column:
    """Rank of a language level, -1 for none, unclear and anything else."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(LEVELS) for x in (v, k)]), level), F.lit(-1))


def nocase(text: Column) -> Column:
    """Sort key that ignores case of ASCII letters only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fingerprint(*parts: Column) -> Column:
    """Digest of parts that may hold any text, joined by a unit separator."""
    return F.sha1(F.concat_ws("\x1f", *parts))
