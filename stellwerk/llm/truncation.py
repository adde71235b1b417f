"""Texts cut off by field limits or in transfer, and the share that each source cuts.

Structure decides first: over each whole text runs a stack automaton of brackets, tags and quotation marks, and what it
leaves open in the last line, wherever that began, is a cut; so are broken multi-byte sequences, entities, escapes and
tags at the end, and explicit marks of omission. For what these leave open, log-odds are added up: of the source's
baseline of missing terminators, of its limits, of what is left open in earlier lines (as often as in texts that are
cut on trial, against whole ends), and of what the end itself says: whether it ends as lines and sentences end, or in
the middle. The last is a linear classifier on the last tokens. It is fitted at run time on a bounded number of texts (``SAMPLE_TEXTS``, chosen by a hash of the text) that it cuts itself: ends
of lines and sentences, with or without their full stop, are whole ends, other places are cuts. Which words it takes
for whole ones is counted over all texts (:func:`known_words`).

A source's baseline is the share of its texts that end without a terminator; its limits are lengths, in characters or
bytes, at which a share of its texts ends that chance does not explain (``LIMIT_SHARE``), counted over all distinct
texts of the source: copies are one text.

Defined results: null, empty and blank texts are not cut; a text that was cut right after a sentence, or within a
number of 16 digits or more (longer than quantities, dates and telephone numbers are; its beginning is such a number,
too), with nothing left open, cannot be told from a whole one and is not reported; texts of any length are read whole; repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stellwerk.llm.samples import distinct_texts
from stellwerk.session import ship

#: Texts that the classifier of ends is fitted on, at most.
SAMPLE_TEXTS = 6000
#: Bits of the map of known words: its size is one whatever the corpus.
KNOWN_BITS = 26
#: Words that a task holds before it hands them on.
HELD_WORDS = 500_000
#: A length at which this share of a source's texts ends, and LIMIT_TEXTS texts or more, is a limit.
LIMIT_SHARE, LIMIT_TEXTS = 0.02, 8
#: Limits within so many characters are one: marks of omission vary a little.
NEARBY = 4
#: Log-odds of a cut: for a text of a limit's length, and against it for one that ends with a terminator.
AT_LIMIT, TERMINATED = 3.0, 1.0
#: The classifier of ends sees so many tokens, within so many characters, of the last line. The marks that an end is
#: checked for (of omission, escapes, placeholders) are shorter than MARK characters; brackets and quotations are
#: followed through the whole text.
TOKENS, TAIL, MARK = 12, 300, 80

PAIRS = {"(": ")", "[": "]", "{": "}", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "<": ">"}
_MARKS = re.compile(r"[()\[\]{}„“”«»「」『』（）]|<(?=/?[A-Za-z!])|(?<=[A-Za-z\"'/])>")
_OMISSION = re.compile(r"\s*(?:\[(?:mehr|more|…|\.\.\.)\]|(?:…|\.\.\.)\s*(?:\(?(?:weiterlesen|mehr(?: anzeigen| lesen)?|read more|more)\)?)?|\((?:mehr|more)\))\s*$", re.I)
_EXPLICIT = re.compile(r"(?:\[(?:mehr|more)\]|weiterlesen|mehr anzeigen|mehr lesen|read more|\((?:mehr|more)\))\s*$", re.I)
_BROKEN = re.compile(r"(?:�+|&(?:[a-z]{1,6}|#\d{0,5}|#x[0-9a-f]{0,5})|<(?:/?[a-z][a-z0-9]{0,9}(?:\s[^<>]{0,80})?)?)$", re.I)
#: Escapes that are not over: a backslash-u with three digits or fewer, and a percent sign inside a word or an address (not after a number: "1,5 %").
_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\u[0-9a-f]{0,3}$|(?:[^\W\d]|[/=&?#.~+-]|%[0-9a-f]{2})%[0-9a-f]?$", re.I)
#: Placeholders that end with a percent sign.
_PERCENT_FIELD = re.compile(r"%%\w+%%$|(?<![\w%])%(?![0-9a-fA-F]{2}%)\w+%$")
_ENTITY = re.compile(r"&(?:a(?:mp?)?|n(?:b(?:sp?)?)?|l(?:t)?|g(?:t)?|q(?:u(?:ot?)?)?|[aou](?:u(?:ml?)?)?|s(?:z(?:l(?:ig?)?)?)?|e(?:u(?:ro?)?)?|#\d{0,5}|#x[0-9a-f]{0,5})$", re.I)
_TOKEN = re.compile(r"\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,}\b|\d+|[^\W\d_]+|[^\w\s]|_+")
_LONG = re.compile(r"(?<![^\W_])\d{16,}$")
_IDENTIFIER = re.compile(r"(?<![^\W_])(?=[^\W_]*\d)[^\W_]{6,}$")
_END = re.compile(r"[.!?…:;)\]}“”»\"'。！？]$")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?](?=\s+[A-ZÄÖÜ„\"])")


def open_at_end(text: str) -> list[tuple[str, int]]:
    """Openers that are never closed, with their positions: what the stack holds when the text is over."""
    stack: list[tuple[str, int]] = []
    awaited: Counter[str] = Counter()
    for m in _MARKS.finditer(text):
        c = m[0]
        if c in PAIRS:
            stack.append((c, m.start()))
            awaited.update(PAIRS[c])
        elif awaited[c]:
            for k in range(len(stack) - 1, -1, -1):
                if c in PAIRS[stack[k][0]]:
                    for o, _ in stack[k:]:
                        awaited.subtract(PAIRS[o])
                    del stack[k:]
                    break
    return stack


def _shape(token: str) -> str:
    if token.isdigit():
        return "9" if len(token) < 16 else "LONG"
    return "HEX" if not token.isalpha() and token.isalnum() else token


def features(text: str, known: Container[str] | None) -> list[str]:
    """What the end of a text shows: its last tokens, as they are and by kind."""
    line = text[max(text.rfind("\n"), text.rfind("\r"), len(text) - TAIL) + 1 :]
    tokens = [_shape(t) for t in _TOKEN.findall(line)[-TOKENS:]]
    if not tokens:
        return ["empty"]
    last = tokens[-1]
    two = tokens[-2] if len(tokens) > 1 else "^"
    three = tokens[-3] if len(tokens) > 2 else "^"
    glued = line[-1:].isspace()
    out = [
        "1=" + last,
        "2=" + two + " " + last,
        "3=" + three + " " + two + " " + last,
        "4=" + " ".join(tokens[-4:]),
        "5=" + " ".join(tokens[-5:]),
        "L=" + " ".join(tokens) + str(glued),
        "c=" + line.rstrip()[-1:],
        "t=" + line.rstrip()[-3:],
        "g" if glued else "n",
        "k=" + ("num" if last[:1] in "9L" else "low" if last.islower() else "cap" if last[:1].isupper() else "mark"),
        "l=" + str(min(len(tokens), 6)),
    ]
    if last.isalpha():
        out.append("w=" + str(min(len(last), 5)) + ("" if known is None else "k" if last in known else "u"))
        if known is not None and last not in known:
            out.append("u")
            out.append("u2=" + two)
    return out


@dataclass(frozen=True)
class WordMap:
    """Words by one bit of a hash each: those put in are in it, and as many others as bits are taken by chance."""

    buckets: dict[int, bytes]

    def __contains__(self, word: str) -> bool:
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << KNOWN_BITS) - 1)
        bucket = self.buckets.get(slot >> 15)
        return bucket is not None and bool(bucket[(slot & 0x7FFF) >> 3] >> (slot & 7) & 1)


def _inner_words(text: str) -> set[str]:
    """The words of a text without its last one, which may be the rest of a word, before a mark of omission too."""
    text = text.rstrip()
    text = (text[:-MARK] + _OMISSION.sub("", text[-MARK:])).rstrip()
    return set(_WORD.findall(text[: max(0, text.rfind(" "))]))


def known_words(texts: DataFrame) -> WordMap:
    """The words that two distinct texts or more have, over all of ``texts``.

    A word is in two texts if the least and the greatest hash of its texts differ, so what is gathered is a row per
    word and task, not per text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, int] = {}
        twice: set[str] = set()

        def held() -> pa.RecordBatch:
            words = [w for w in first if w not in twice]
            n = len(words)
            out = pa.RecordBatch.from_arrays(
                [pa.array([*words, *twice], pa.string()), pa.array([first[w] for w in words] + [0] * len(twice), pa.int64()), pa.array([False] * n + [True] * len(twice), pa.bool_())], names=["word", "mark", "twice"]
            )
            first.clear()
            twice.clear()
            return out

        for batch in batches:
            for t, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in _inner_words(t.as_py()) - twice:
                    if first.setdefault(w, mark) != mark:
                        twice.add(w)
                if len(first) >= HELD_WORDS:
                    yield held()
        yield held()

    words = texts.filter(F.length("text") > 0).select("text", F.xxhash64("text").alias("mark")).mapInArrow(run, "word string, mark bigint, twice boolean")
    slot = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << KNOWN_BITS) - 1)
    slots = words.groupBy("word").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.bool_or("twice").alias("twice")).filter(F.col("twice") | (F.col("lo") != F.col("hi"))).select(slot.alias("slot"))
    # All slots of a bucket in one task first, else each task would send a map of every bucket.
    by = slots.withColumn("bucket", F.shiftright("slot", 15)).repartition("bucket").groupBy("bucket")
    return WordMap({r[0]: bytes(r[1]) for r in by.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1))).collect()})


@dataclass
class Ends:
    """Weights of the features of ends, the words seen in two texts or more, and what an opener left open in an earlier line tells."""

    weights: dict[str, float]
    bias: float
    known: Container[str]
    left_open: float = 0.0

    def score(self, text: str) -> float:
        """Log-odds of a cut."""
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(text, self.known))


def fit_ends(texts: list[str], known: Container[str] | None = None, *, cuts: int = 5, ends: int = 6, l2: float = 2e-5, steps: int = 60, seed: int = 11) -> Ends:
    """The classifier of ends, on the given texts; without ``known`` words, those of two of these texts or more."""
    rng = random.Random(seed)
    if known is None:
        seen = Counter(w for t in texts for w in _inner_words(t))
        known = frozenset(w for w, n in seen.items() if n >= 2)
    rows: list[list[str]] = []
    labels: list[int] = []
    # Prefixes that leave something open in an earlier line, of whole ends and of cuts.
    opened, seen_ends = [1, 1], [2, 2]

    def note(t: str, e: int, label: int) -> None:
        rows.append(features(t[:e], known))
        labels.append(label)
        seen_ends[label] += 1
        at = max(t.rfind("\n", 0, e), t.rfind("\r", 0, e))
        stack = open_at_end(t[:e]) if at > 0 else []
        opened[label] += bool(stack) and stack[-1][1] < at

    for t in texts:
        t = t.rstrip()
        t = t[:-MARK] + _OMISSION.sub("", t[-MARK:])
        if len(t) < 30:
            continue
        whole = [m.end() for m in re.finditer(r"[^\s](?=\s*[\n\r])", t)]
        stops = [m.end() for m in _SENTENCE.finditer(t)]
        at_end = set(whole) | set(stops) | {s - 1 for s in stops}
        if t[-1] in ".!?":
            stops.append(len(t))
        for e in rng.sample(whole, min(ends, len(whole))) + rng.sample(stops, min(ends, len(stops))):
            note(t, e, 0)
            if t[e - 1] in "." and rng.random() < 0.3:
                note(t, e - 1, 0)
        for _ in range(cuts):
            e = rng.randrange(15, len(t) - 1) if len(t) > 40 else 20
            # The beginning of an identifier is one, too: a cut in it cannot be seen, and teaches that whole ones are cut.
            if t[e].isalnum() and _IDENTIFIER.search(t, max(0, e - TAIL), e):
                continue
            if e not in at_end and t[:e].rstrip() and len(t[:e].rstrip()) not in at_end:
                note(t, e, 1)
    if not rows:
        return Ends({}, 0.0, known)
    names = {f: k for k, f in enumerate(dict.fromkeys(f for r in rows for f in r))}
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([names[f] for r in rows for f in r])
    y = np.array(labels, dtype=np.float64)
    w, b, g2 = np.zeros(len(names)), 0.0, np.full(len(names), 1e-12)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, weights=err[row], minlength=len(names)) + l2 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        b -= err.sum() * 2
    evidence = math.log(opened[1] / seen_ends[1]) - math.log(opened[0] / seen_ends[0])
    return Ends({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 0.02}, float(b), known, evidence)


@dataclass(frozen=True)
class Baseline:
    """What is usual in a source: its limits in characters and in bytes, and the log-odds that an end without terminator is a cut."""

    chars: frozenset[int]
    octets: frozenset[int]
    prior: float


def is_cut(text: str | None, ends: Ends, base: Baseline) -> bool:
    """Whether a text stops before the original did: by structure where that tells, else by the odds."""
    if not text or not text.strip():
        return False
    stack = open_at_end(text)
    bare = text.rstrip()
    at_limit = any(abs(len(text) - n) <= 1 for n in base.chars) or any(0 <= n - len(text.encode("utf-8", "surrogatepass")) <= 3 for n in base.octets)
    if _EXPLICIT.search(bare):
        return True
    if (m := _BROKEN.search(bare)) and ("�" in m[0] or m[0][0] == "<" or (m[0][0] == "&" and _ENTITY.search(bare))):
        return True
    if _ESCAPE.search(bare[-MARK:]) and not _PERCENT_FIELD.search(bare[-MARK:]):
        return True
    m = _OMISSION.search(bare[-MARK:])
    if m and m[0].strip():
        near_limit = any(abs(len(bare) - n) <= NEARBY for n in base.chars)
        start = max(0, len(bare) - MARK) + m.start()
        body = text[:start]
        odds = ends.score(body)
        spaced = text[start : start + 1].isspace()
        return near_limit or bool(stack and stack[-1][1] > bare.rfind("\n") and odds > -2) or odds > (3.0 if spaced else 1.0)
    line = max(bare.rfind("\n"), bare.rfind("\r"))
    if stack and stack[-1][1] > line:
        return True
    if _LONG.search(bare, max(0, len(bare) - MARK)):
        return False
    odds = ends.score(text if text[-1] not in "\n\r" else bare) + base.prior
    if stack:
        odds += ends.left_open
    if at_limit:
        odds += AT_LIMIT
    if _END.search(bare) or not bare[-1].isalnum():
        odds -= TERMINATED
    return odds > 0


def baselines(texts: DataFrame) -> dict[tuple[str, str], Baseline]:
    """The baseline of each (origin, source), from counts over all its distinct texts; a handful of rows for each source."""
    by = ["origin", "source"]
    closed = F.rlike(F.substring(F.rtrim("text"), -2, 2), F.lit("[.!?…:;)\\]}“”»\"'。！？]\\s?$"))
    counts = (
        texts.filter(F.length("text") > 0)
        .select(*by, F.xxhash64("text").alias("mark"), F.length("text").alias("chars"), F.octet_length("text").alias("octets"), closed.alias("closed"))
        .distinct()
        .groupBy(*by, "chars", "octets")
        .agg(F.count("*").alias("n"), F.count_if("closed").alias("n_closed"))
    )
    # From here on there is a row per source and length, not per text.
    whole, same_chars, same_octets = Window.partitionBy(*by), Window.partitionBy(*by, "chars"), Window.partitionBy(*by, "octets")
    limit = lambda n: (n >= LIMIT_TEXTS) & (n >= LIMIT_SHARE * F.col("total"))
    rows = (
        counts.withColumn("total", F.sum("n").over(whole))
        .withColumn("as_chars", F.sum("n").over(same_chars))
        .withColumn("as_octets", F.sum("n").over(same_octets))
        .groupBy(*by)
        .agg(
            F.sum("n").alias("total"),
            F.sum("n_closed").alias("total_closed"),
            F.collect_set(F.when(limit(F.col("as_chars")), F.col("chars"))).alias("chars"),
            F.collect_set(F.when(limit(F.col("as_octets")), F.col("octets"))).alias("octets"),
        )
    )
    out = {}
    for r in rows.collect():
        rate = (r["total"] - r["total_closed"] + 1) / (r["total"] + 2)
        out[r["origin"], r["source"]] = Baseline(frozenset(r["chars"] or ()), frozenset(r["octets"] or ()), max(-2.5, min(0.5, math.log(rate / (1 - rate)) / 2 + 0.8)))
    return out


def sample_texts(texts: DataFrame, limit: int = SAMPLE_TEXTS) -> DataFrame:
    """(text) of at most ``limit`` distinct texts, those of the smallest hash."""
    return distinct_texts(texts.filter(F.length("text") > 40), "text", limit).select("text")


def find_cut(texts: DataFrame, ends: Ends, base: dict[tuple[str, str], Baseline]) -> DataFrame:
    """(origin, source, row_key, cut) of ``texts`` (origin, source, row_key, text) that are not blank."""
    ship(texts.sparkSession)
    usual = Baseline(frozenset(), frozenset(), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [is_cut(t.as_py(), ends, base.get((o.as_py(), s.as_py()), usual)) for o, s, t in zip(batch.column(0), batch.column(1), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.bool_())], names=["origin", "source", "row_key", "cut"])

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("origin", "source", "row_key")] + [T.StructField("cut", T.BooleanType())])
    return texts.filter(F.length("text") > 0).select("origin", "source", "row_key", "text").mapInArrow(run, schema)


def cut_shares(found: DataFrame) -> DataFrame:
    """(origin, source, n_texts, n_cut, share_cut)."""
    return found.groupBy("origin", "source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
