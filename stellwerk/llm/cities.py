"""Mapping of towns as typed to a reference list, with what has no entry reported.

Distinct typed values are read first (postcode, country and state names, words about the place within the town and
connecting words are set apart; wrong decodings, spaced-out letters and abbreviations undone), then joined with the
spellings of the reference entries by a prefix-filter set-similarity join over letter pairs (:mod:`setsim`), at the
threshold that no slip in any spelling of the list falls below (:func:`least_similarity`). Of the verified pairs that
are within the edits that a typing slip makes, the best are kept: those of the fewest edits (a swap of neighbours
changes more letter pairs than a letter left out, so similarity alone would rank a longer name's beginning above the
name itself), then whole names before parts of names. Values that leave several entries open are settled by the
postcode, the one in the text before the one beside it.

Defined results: null and blank values are no case; a value that no entry is close to has 0, so has one that leaves
several entries open which no postcode settles; ties go to the postcode, then to 0. Repeated rows keep their own
result rows; very long values are read like others (they match nothing). Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.llm.setsim import grams, similarity_join
from stellwerk.llm.strings import Near, distance, spell_out, strip_marks, tidy
from stellwerk.session import cut, ship

# Words that may stand beside a town's name and do not name it.
BESIDE = frozenset(
    "stadt gemeinde raum großraum grossraum nähe naehe in ort umgebung umkreis region kreis landkreis zentrum innenstadt mitte altstadt bahnhof nord süd sued ost west ot ortsteil siedlung deutschland germany homeoffice remote mobil hybrid und".split()
)
# Words that connect a name with its qualifier, and their short forms.
LINKS = frozenset("an am a der d dem den im i bei b ob o vor v vd de".split())
SAINT = {"st": "sankt", "skt": "sankt", "sankt": "sankt"}
_WORD = re.compile(r"[^\W\d_]+\.?")
_CODE = re.compile(r"(?<!\d)(?:d|de)?[-\s]*(\d{5})(?!\d)", re.I)
_SPACED = re.compile(r"(?:\w\.? ){3,}\w\.?")
_COUNTRY = re.compile(r"(?<=[,(/\s])\s*(?:de|d|brd|ger)\s*\)?\.?$", re.I)


@functools.lru_cache(maxsize=8)
def _index(words: frozenset[str]) -> Near:
    return Near(words)


def read_value(text: str, states: frozenset[str]) -> tuple[str, str, bool]:
    """(core, postcode, cut short): the letters that name the town, joined."""
    s = tidy(text)
    code = ""
    if m := _CODE.search(s):
        code = m[1]
        s = s[: m.start()] + " " + s[m.end() :]
    s = _COUNTRY.sub("", s)
    if _SPACED.fullmatch(s.strip()):
        s = s.replace(" ", "")
    words = _WORD.findall(s.lower())
    bare = [SAINT.get(w.rstrip("."), w.rstrip(".")) for w in words]
    kept = [w for w in bare if w not in LINKS]
    named = [w for w in kept if not _index(BESIDE).has(w, 4, 5)]
    if len(named) > 1:
        trimmed = [w for w in named if not _index(states).has(w, 4, 5)]
        named = trimmed or named
    short = len(named) == 1 and any(w.endswith(".") and w.rstrip(".") == named[0] for w in words)
    return "".join(named), code, short


def spellings(name: str) -> dict[str, str]:
    """Spellings of an entry: 'full' for the whole name, 'base' without its qualifier, 'short' for its beginnings."""
    out: dict[str, str] = {}
    for fold in (str.lower, spell_out, strip_marks):
        words = [SAINT.get(w, w) for w in re.findall(r"[^\W\d_]+", fold(name))]
        named = [w for w in words if w not in LINKS]
        lead = named[0] if named and named[0] in ("bad", "sankt", "markt") else None
        base = named[1] if lead and len(named) > 1 else named[0]
        for full in ("".join(words), "".join(named), "".join(named[1:] + named[:1])):
            out.setdefault(full, "full")
        if base != "".join(named):
            out.setdefault(base, "base")
        for n in range(3, min(len(named[0]), 9)):
            out.setdefault(named[0][:n] + ".", "short")
    return out


def reach(core: str) -> int:
    """Edits that count as a slip in a name as typed."""
    return 0 if len(core) < 4 else 1 if len(core) < 14 else 2


def least_similarity(names: Iterable[str]) -> float:
    """The least Jaccard similarity of letter pairs that a spelling of these names has with any slip in it.

    The worst slip is a swap of neighbours: three pairs go and three come.
    """
    least = 1.0
    for name in names:
        for s in spellings(name):
            bare = s.rstrip(".")
            pairs = len({("^" + bare + "$")[i : i + 2] for i in range(len(bare) + 1)})
            edits = max(reach(bare), reach(bare + "xx"))
            gone = 3 * edits if len(bare) > 3 else 1
            least = min(least, (pairs - gone) / (pairs + max(gone, 2)) if edits else 1.0)
    # Whatever is left of a very short name: one pair in common is needed.
    return max(least, 0.05)


def decide(core: str, short: bool, candidates: list[tuple[str, int, str, str]]) -> list[tuple[int, str]]:
    """The closest entries, as (city_id, postcode prefix), of candidates (spelling, city_id, kind, postcode prefix)."""
    best: tuple[int, int] | None = None
    found: dict[int, str] = {}
    for spelling, city, kind, prefix in candidates:
        if (kind == "short") != short and kind == "short":
            continue
        d = distance(core, spelling.rstrip("."), max(1, reach(core)))
        if d > reach(core):
            continue
        rank = (d, {"full": 0, "base": 1, "short": 2}[kind])
        if best is None or rank < best:
            best, found = rank, {}
        if rank == best:
            found[city] = prefix
    return sorted(found.items())


def map_cities(rows: DataFrame, ref: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """``rows`` (origin, row_key, city, plz) that are no exact entry, with the ``city_id`` meant, or 0.

    ``ref`` has city_id, name, region_name and plz_prefix; it is a reference list, whose names the driver reads to
    set the threshold. Rows only meet the result for their distinct value.
    """
    ship(rows.sparkSession)
    if threshold is None:
        threshold = least_similarity(r[0] for r in ref.filter(F.length(F.trim("name")) > 0).select("name").distinct().toLocalIterator())
    states = frozenset(w for (r,) in ref.select("region_name").distinct().collect() for fold in (str.lower, spell_out, strip_marks) for w in re.findall(r"[^\W\d_]+", fold(r or "")) if len(w) > 3)

    @F.arrow_udf(T.StructType([T.StructField("core", T.StringType()), T.StructField("code", T.StringType()), T.StructField("short", T.BooleanType())]))
    def read(city: pa.Array) -> pa.Array:
        got = [read_value(x or "", states) for x in city.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())], names=["core", "code", "short"])

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("spelling", T.StringType()), T.StructField("kind", T.StringType())])))
    def spell(name: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("spelling", pa.string()), ("kind", pa.string())]))
        return pa.array([[{"spelling": s, "kind": k} for s, k in spellings(n or "-").items()] for n in name.to_pylist()], kind)

    entries = (
        ref.filter(F.length(F.trim("name")) > 0)
        .select("city_id", F.coalesce("plz_prefix", F.lit("")).alias("plz_prefix"), F.explode(spell("name")).alias("s"))
        .select("s.spelling", "s.kind", "city_id", "plz_prefix")
        .groupBy("spelling")
        .agg(F.collect_list(F.struct("spelling", "city_id", "kind", "plz_prefix")).alias("entries"))
    )
    cases = rows.select("origin", "row_key", "city", "plz").filter(F.length(F.regexp_replace("city", "(?U)[\\s\\p{Z}]", "")) > 0).join(ref.select(F.col("name").alias("city")), "city", "left_anti")
    values = cut(cases.select("city").distinct().withColumn("r", read("city")).select("city", "r.*"))
    cores = values.select("core", "short").distinct().withColumn("core_key", F.concat("core", F.when(F.col("short"), F.lit(".")).otherwise("")))
    pairs = similarity_join(
        cores.filter("core != ''").select("core_key", grams(F.col("core")).alias("tokens")),
        entries.select("spelling", grams(F.regexp_replace("spelling", "\\.$", "")).alias("tokens")),
        "core_key",
        "spelling",
        "tokens",
        threshold,
    )

    open_type = T.ArrayType(T.StructType([T.StructField("city_id", T.IntegerType()), T.StructField("plz_prefix", T.StringType())]))

    @F.arrow_udf(open_type)
    def closest(key: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for k, lists in zip(key.to_pylist(), found.to_pylist(), strict=True):
            options = [(e["spelling"], e["city_id"], e["kind"], e["plz_prefix"]) for es in lists for e in es]
            out.append([{"city_id": c, "plz_prefix": p} for c, p in decide(k.rstrip("."), k.endswith("."), options)])
        return pa.array(out, pa.list_(pa.struct([("city_id", pa.int32()), ("plz_prefix", pa.string())])))

    decided = (
        pairs.join(entries, "spelling").groupBy("core_key").agg(F.collect_list("entries").alias("found"))
        .select("core_key", closest("core_key", "found").alias("open"))
    )
    meant = (
        values.withColumn("core_key", F.concat("core", F.when(F.col("short"), F.lit(".")).otherwise("")))
        .join(decided, "core_key", "left")
        .select("city", "code", F.coalesce("open", F.array().cast(open_type)).alias("open"))
    )
    by_text = F.filter("open", lambda e: (F.length(e["plz_prefix"]) > 0) & F.startswith(F.col("code"), e["plz_prefix"]))
    by_column = F.filter("open", lambda e: (F.length(e["plz_prefix"]) > 0) & F.startswith(F.coalesce("plz", F.lit("")), e["plz_prefix"]))
    only = lambda a: F.when(F.size(a) == 1, a[0]["city_id"])
    return (
        cases.join(meant, "city", "left")
        .withColumn("city_id", F.coalesce(only(F.col("open")), only(by_text), only(by_column), F.lit(0)).cast("int"))
        .select("origin", "row_key", "city_id")
    )
