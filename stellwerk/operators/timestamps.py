"""Mixed timestamp notations, brought to whole seconds since the epoch in UTC.

Each value is reduced to a *shape mask* by character class (every digit ``9``, every run of letters ``a``, other
characters as they are, runs of blanks as one blank). Masks are few, values many: each distinct mask is resolved to
one parser, once per worker process, and the parser then runs over all values of that mask as a vectorised
regular-expression extraction and integer arithmetic. Wall-clock times go through a zone transition table
(:class:`ZoneTable`), which carries the version of the zone database that it was built from.

Defined results:

* null, blank, unknown shapes, impossible dates or times, years outside ``[1990, 2100]``, a bare year: null;
* a value without zone is wall clock time of ``zone``; of a doubled hour the first; a skipped time moves on by
  the skipped hour; a bare day is its 00:00 there;
* an explicit offset wins over a region name in brackets; letters after the time are a zone only if known;
* words such as "heute" and "vor 3 Tagen" count from the reference column; if that is null, the result is null;
* fractions of seconds are dropped (towards the past); two-digit years are 20xx; with slashes the month is first;
* repeated rows give repeated results; extra columns pass through; the empty table gives the empty table.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1990, 2100

# Month names, German and English, with the common short forms.
MONTHS = {
    "januar": 1, "jänner": 1, "january": 1, "jan": 1, "februar": 2, "february": 2, "feb": 2, "märz": 3, "maerz": 3, "march": 3, "mär": 3, "mrz": 3, "mar": 3,
    "april": 4, "apr": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "jun": 6, "juli": 7, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10, "november": 11, "nov": 11, "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}
# Zone letters and their offsets in minutes.
ZONE_LETTERS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "cet": 60, "mez": 60, "bst": 60, "west": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "ist": 330, "jst": 540,
}
# Words for days, and units of "n units ago" in seconds or (negative) days.
DAY_WORDS = {"heute": 0, "today": 0, "gestern": 1, "yesterday": 1, "vorgestern": 2}
NOW_WORDS = {"jetzt", "now", "gerade", "soeben"}
UNITS = {
    "sekunde": 1, "sekunden": 1, "sek": 1, "second": 1, "seconds": 1, "sec": 1, "secs": 1, "minute": 60, "minuten": 60, "min": 60, "minutes": 60, "mins": 60,
    "stunde": 3600, "stunden": 3600, "std": 3600, "hour": 3600, "hours": 3600, "hr": 3600, "hrs": 3600, "h": 3600,
    "tag": -1, "tage": -1, "tagen": -1, "day": -1, "days": -1, "woche": -7, "wochen": -7, "week": -7, "weeks": -7,
}


@dataclass(frozen=True)
class ZoneTable:
    """UTC instants at which a zone's offset changes, the offsets between them, and the database's version."""

    zone: str
    version: str
    instants: np.ndarray
    offsets: np.ndarray
    local_switch: np.ndarray

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall clock seconds to UTC: of a doubled hour the first, a skipped time with the offset before the gap."""
        return wall - self.offsets[np.searchsorted(self.local_switch, wall, side="right")]

    def to_wall(self, utc: np.ndarray) -> np.ndarray:
        return utc + self.offsets[np.searchsorted(self.instants, utc, side="right")]


def zone_version() -> str:
    """Version of the zone database in use."""
    for folder in TZPATH:
        p = Path(folder) / "tzdata.zi"
        if p.exists():
            with p.open() as f:
                return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@functools.lru_cache(maxsize=64)
def zone_table(zone: str) -> ZoneTable:
    """The transition table of ``zone`` for all years that can be asked for, with a margin of two years."""
    info = ZoneInfo(zone)
    offset = lambda t: int(datetime.fromtimestamp(t, info).utcoffset().total_seconds())
    at = int(datetime(FIRST_YEAR - 2, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(LAST_YEAR + 2, 1, 1, tzinfo=timezone.utc).timestamp())
    instants, offsets = [], [offset(at)]
    while at < end:
        nxt = at + 86400 * 3
        if offset(nxt) != offsets[-1]:
            low, high = at, nxt
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            instants.append(high)
            offsets.append(offset(high))
        at = nxt
    t, o = np.array(instants, dtype="int64"), np.array(offsets, dtype="int64")
    return ZoneTable(zone, zone_version(), t, o, t + np.maximum(o[:-1], o[1:]) if len(t) else t)


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists and its year is admitted."""
    ok = (y >= FIRST_YEAR) & (y <= LAST_YEAR) & (m >= 1) & (m <= 12) & (d >= 1)
    ys, ms = np.where(ok, y, 2000), np.where(ok, m, 1)
    month = (ys - 1970) * 12 + (ms - 1)
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype("int64") - first
    return first + d - 1, ok & (d <= length)


_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(?:\s*(?P<z>[A-Za-z]+|[+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\[(?P<region>[A-Za-z_/+-]+)\])?"
_TAIL = rf"(?:(?:,|\s)+(?:um\s+|at\s+)?{_TIME}\s*(?P<half>[AaPp]\.?[Mm]\.?)?(?:\s*Uhr)?{_ZONE})?"
_DAYNAME = r"(?:\pL+\.?,?\s+)?"

# Layouts: a pattern over shape masks, and the pattern that takes the fields out of the values of such a mask.
LAYOUTS: list[tuple[str, str, str]] = [
    ("iso", r"9999-99-99(?:(?:a| )99:99.*)?", rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})(?:[Tt\s]\s*(?P<h>\d{{2}}):(?P<mi>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,]\d+)?)?{_ZONE})?"),
    ("compact", r"99999999(?:a?999999a?|a9999a?)?", r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[Tt]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?P<z>[Zz])?)?"),
    ("epoch", r"9{9,10}(?:\.9+)?", r"(?P<sec>\d+)(?:\.\d+)?"),
    ("epoch_ms", r"9{12,13}", r"(?P<ms>\d+)"),
    ("dots", r"(?:a\.?,? )?99?\. ?99?\. ?(?:9999|99)(?:(?:,| )+.*)?", rf"{_DAYNAME}(?P<d>\d{{1,2}})\.\s?(?P<mo>\d{{1,2}})\.\s?(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    ("day_month", r"(?:a\.?,? )?99?\.? a\.? 9999(?:(?:,| )+.*)?", rf"{_DAYNAME}(?P<d>\d{{1,2}})\.?\s+(?P<mon>\pL+)\.?\s+(?P<y>\d{{4}}){_TAIL}"),
    ("month_day", r"(?:a\.?, )?a\.? 99?(?:a)?, 9999(?:(?:,| )+.*)?", rf"(?:\pL+\.?,\s+)?(?P<mon>\pL+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,\s+(?P<y>\d{{4}}){_TAIL}"),
    ("slashes", r"99?/99?/(?:9999|99)(?:(?:,| )+.*)?", rf"(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_TAIL}"),
    ("ago", r"(?:a )*99*\+? a(?:\.| a)?|(?:a )+99*\+? a\.?(?: a)?", r"(?:(?P<pre>[\pL ]+)\s+)?(?P<n>\d{1,6})\s+(?P<unit>\pL+)\.?(?:\s+(?P<post>\pL+))?"),
    ("day_word", r"a(?:,? ?(?:a )?99?[:.]99(?::99)?(?: a)?)?", rf"(?P<word>\pL+)(?:(?:,|\s)+(?:um\s+|at\s+)?{_TIME}(?:\s*Uhr)?)?"),
]
_COMPILED = [(name, re.compile(mask), f"^{value}$") for name, mask, value in LAYOUTS]


@functools.lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, str] | None:
    """Layout and value pattern of a mask; resolved once per mask and process."""
    for name, over, value in _COMPILED:
        if over.fullmatch(mask):
            return name, value
    return None


def shape_mask(value: Column) -> Column:
    """The shape mask of a string column, computed in the JVM."""
    trimmed = F.regexp_replace(F.regexp_replace(value, "(?U)[\\s\\p{Z}]+", " "), "^ | $", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "[0-9]", "9"), "\\p{L}+", "a")


def _ints(field: pa.Array | None, n: int, default: int) -> np.ndarray:
    if field is None:
        return np.full(n, default, dtype="int64")
    blank = pc.equal(pc.utf8_length(field), 0)
    return pc.fill_null(pc.cast(pc.if_else(blank, None, field), pa.int64()), default).to_numpy(zero_copy_only=False).astype("int64")


def _mapped(field: pa.Array, words: dict[str, int], missing: int) -> np.ndarray:
    keys = pa.array(list(words))
    index = pc.fill_null(pc.index_in(pc.utf8_lower(field), value_set=keys), len(words))
    return np.append(np.array(list(words.values()), dtype="int64"), missing)[index.to_numpy(zero_copy_only=False)]


_BAD = -(2**40)


def parse_values(mask: str, values: pa.Array, reference_s: np.ndarray, has_reference: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Epoch seconds, and which are valid, of trimmed values that share one mask."""
    n = len(values)
    none = np.zeros(n, dtype="int64"), np.zeros(n, dtype=bool)
    if (found := parser_of(mask)) is None:
        return none
    layout, pattern = found
    parts = pc.extract_regex(values, pattern=pattern)
    ok = parts.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    if not ok.any():
        return none
    names = {f.name for f in parts.type}
    field = lambda k: pc.fill_null(pc.struct_field(parts, k), "") if k in names else None
    berlin = zone_table(zone)

    if layout in ("epoch", "epoch_ms"):
        s = _ints(field("sec"), n, 0) if layout == "epoch" else _ints(field("ms"), n, 0) // 1000
        year = s.astype("datetime64[s]").astype("datetime64[Y]").astype("int64") + 1970
        return s, ok & (year >= FIRST_YEAR) & (year <= LAST_YEAR)
    if layout == "ago":
        step = _mapped(field("unit"), UNITS, 0)
        amount = _ints(field("n"), n, 0)
        pre = pc.utf8_lower(field("pre")).to_pylist()
        post = pc.utf8_lower(field("post")).to_pylist()
        said = np.array([(a.split()[-1:] == ["vor"] and not b) or b == "ago" for a, b in zip(pre, post, strict=True)], dtype=bool)
        day = berlin.to_wall(reference_s) // 86400 + step * amount
        s = np.where(step > 0, reference_s - step * amount, berlin.to_utc(day * 86400))
        return s, ok & said & (step != 0) & has_reference & _in_years(s)
    h, mi, sec = _ints(field("h"), n, 0), _ints(field("mi"), n, 0), _ints(field("s"), n, 0)
    if layout == "day_word":
        word = field("word")
        back = _mapped(word, DAY_WORDS, _BAD)
        ok &= (back != _BAD) & has_reference
        days = berlin.to_wall(reference_s) // 86400 - np.where(ok, back, 0)
    else:
        y = _ints(field("y"), n, 0)
        y = np.where(y < 100, y + 2000, y) if layout in ("dots", "slashes") else y
        mo = _mapped(field("mon"), MONTHS, 0) if "mon" in names else _ints(field("mo"), n, 0)
        days, exists = days_from_civil(y, mo, _ints(field("d"), n, 0))
        ok &= exists
    if "half" in names:
        half = pc.utf8_lower(pc.utf8_slice_codeunits(field("half"), 0, 1))
        pm, am = (pc.equal(half, x).to_numpy(zero_copy_only=False).astype(bool) for x in "pa")
        ok &= ~(pm | am) | ((h >= 1) & (h <= 12))
        h = np.where(pm & (h < 12), h + 12, np.where(am & (h == 12), 0, h))
    ok &= (h <= 23) & (mi <= 59) & (sec <= 59)
    wall = days * 86400 + h * 3600 + mi * 60 + sec
    s = berlin.to_utc(wall)
    if "z" in names:
        z = field("z")
        first = pc.utf8_slice_codeunits(z, 0, 1)
        signed = pc.is_in(first, value_set=pa.array(["+", "-"])).to_numpy(zero_copy_only=False).astype(bool)
        letters = pc.greater(pc.utf8_length(z), 0).to_numpy(zero_copy_only=False).astype(bool) & ~signed
        digits = pc.replace_substring_regex(z, r"[^0-9]", "")
        hours = _ints(pc.if_else(pa.array(signed), pc.utf8_slice_codeunits(digits, 0, 2), ""), n, 0)
        minutes = _ints(pc.if_else(pa.array(signed), pc.utf8_slice_codeunits(digits, 2, 4), ""), n, 0)
        sign = np.where(pc.equal(first, "-").to_numpy(zero_copy_only=False).astype(bool), -1, 1)
        named = _mapped(z, ZONE_LETTERS, _BAD)
        ok &= ~letters | (named != _BAD)
        ok &= ~signed | ((hours <= 18) & (minutes <= 59))
        s = np.where(signed, wall - sign * (hours * 3600 + minutes * 60), np.where(letters & (named != _BAD), wall - named * 60, s))
        if "region" in names:
            region = field("region")
            for r in pc.unique(region).to_pylist():
                if r:
                    here = pc.equal(region, r).to_numpy(zero_copy_only=False).astype(bool) & ~signed & ~letters
                    if here.any():
                        try:
                            s = np.where(here, zone_table(r).to_utc(wall), s)
                        except Exception:  # noqa: BLE001 - a region that the zone database lacks
                            ok &= ~here
    return s, ok


def _in_years(s: np.ndarray) -> np.ndarray:
    year = s.astype("datetime64[s]").astype("datetime64[Y]").astype("int64") + 1970
    return (year >= FIRST_YEAR) & (year <= LAST_YEAR)


def parse_batch(values: pa.Array, masks: pa.Array, reference: pa.Array, zone: str) -> pa.Array:
    """Epoch seconds of a batch of raw values with their masks; null where there is no moment."""
    n = len(values)
    out, valid = np.zeros(n, dtype="int64"), np.zeros(n, dtype=bool)
    if n:
        micros = pc.cast(pc.cast(reference, pa.timestamp("us", reference.type.tz)), pa.int64())
        has = pc.is_valid(micros).to_numpy(zero_copy_only=False).astype(bool)
        ref = pc.fill_null(micros, 0).to_numpy(zero_copy_only=False).astype("int64") // 1_000_000
        clean = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
        coded = pc.dictionary_encode(pc.fill_null(masks, ""))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for k, mask in enumerate(coded.dictionary.to_pylist()):
            if mask:
                at = order[starts[k] : starts[k + 1]]
                s, ok = parse_values(mask, clean.take(pa.array(at)), ref[at], has[at], zone)
                out[at], valid[at] = s, ok
    return pa.array(out, mask=~valid)


def to_epoch_seconds(value: Column, reference: Column, zone: str = "Europe/Berlin") -> Column:
    """Whole seconds since the epoch of a timestamp in any known notation, or null (see the module's text)."""

    @F.arrow_udf("bigint")
    def run(v: pa.Array, m: pa.Array, r: pa.Array) -> pa.Array:
        return parse_batch(v, m, r, zone)

    # Marked nondeterministic, so that a filter on the result does not make it run twice.
    return run.asNondeterministic()(value, shape_mask(value), reference)


def with_epoch_seconds(df: DataFrame, value: str, reference: str, out: str = "epoch_s", zone: str = "Europe/Berlin") -> DataFrame:
    """``df`` with the column ``out``; rows are never dropped."""
    return df.withColumn(out, to_epoch_seconds(F.col(value), F.col(reference), zone))


def mask_report(df: DataFrame, value: str, reference: str, zone: str = "Europe/Berlin") -> DataFrame:
    """Rows and parsed rows by shape mask: what a new source's notation would show up in."""
    return (
        with_epoch_seconds(df, value, reference, "_epoch_s", zone)
        .groupBy(shape_mask(F.col(value)).alias("mask"))
        .agg(F.count("*").alias("n_rows"), F.count("_epoch_s").alias("n_parsed"))
    )
