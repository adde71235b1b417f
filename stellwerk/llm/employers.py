"""Linking the spellings of one employer by a noisy channel.

Each distinct spelling is read into what tells an employer: its line of business and its family names or brand.
Legal form, first names, places and branches, and the manner of writing (order, case, separators, umlauts, wrong
decodings, look-alike letters, spaced or hyphenated compounds) are set apart. What is left is a noisy spelling of some
canonical reading of the same line of business. The hypotheses of a reading with ``c`` rows are

* a candidate reading with ``N`` rows, of which it is a slip: ``N * SLIP ** slips / c ** 2`` (its prior is its
  frequency; that one slip is copied to ``c`` rows gets rarer with ``c``);
* itself, another employer that happens to be so close: ``COLLISION ** slips``;

and it is attached to the one of maximum posterior, which may be itself. Chains end at their most probable reading
(pointer jumping), and all spellings there are one employer.

Lines of business: a dictionary (``TRADES``, a parameter) gives words to begin with; further ones are learned
(:func:`learn_lines`): a word that accompanies many different names and mostly stands alone with them (a first name
needs a line beside it). Two learned words are one line if most employers of the rarer one also use the other. An
abbreviation is a subsequence of a line's word that keeps its beginning, a long one with a letter wrong, too; if it
fits several lines, each is a hypothesis, and the frequency of the names with that line decides.

Candidates are found by a shared deletion neighbour of a name within the line of business, folded or with the umlauts
as anyone typed them: no pair is formed without one, no block is capped; of several names the rarest is looked up. Each
name has one slip at most: two edits in one name are, even in long names, mostly another employer. Readings without
line of business are compared with each other by all their words. Names written apart and abbreviations that fit
several lines are looked up likewise, at the price of a slip.

Defined results: null and blank values, and values without a readable name, are linked with nothing; a name of two
letters counts where there is no longer one, and has to be exact; values of any length are read whole; ties between
candidates, and between equally frequent readings, go to the reading that more others are near, then to the one that
sorts first; a reading without line of business joins the only employer that has its names (one slip each at most), if
there is exactly one, however many readings it has, and if what is said beside them are first names or initials; only
if it joins none, it is linked with others without. Extra columns are ignored, repeated rows only count as frequency.
"""

from __future__ import annotations

import functools
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.llm.strings import Near, distance, tidy
from stellwerk.session import cut, ship

# Lines of business with the words that name them.
TRADES = """
apotheke
architekturbüro architekten architekt
autohaus kfz-handel automobile autohandel kfz-betrieb kfz-meisterbetrieb
bäckerei backstube bäckereibetrieb backhaus
baumarkt heimwerkermarkt
blumenhaus floristik blumen blumenladen
brauerei brauhaus braustätte
buchhandlung buchladen buchhdlg
catering partyservice event-catering
dachdeckerei dachdecker dachdeckerbetrieb
druckerei druckhaus druckereibetrieb
eiscafé eisdiele
elektrotechnik elektro e-technik elektrobetrieb
fahrradladen radladen zweirad fahrräder
fahrschule
feinkost delikatessen feinkostladen
fitnessstudio fitnesscenter fitness
friseursalon haarstudio friseur
gartenbau galabau garten-und-landschaftsbau gärtnerei
gasthof gasthaus gsth
gebäudereinigung reinigung reinigungsservice reinigungsdienst
getränkemarkt getränkehandel getränke
großhandel grosshandel
hausverwaltung immobilienverwaltung
heizungsbau heizung-und-sanitär heizung
hotel htl hotelbetrieb
ingenieurbüro ingenieure
kantine kantinenbetrieb betriebsgastronomie
kindergarten kita kindertagesstätte
konditorei konditoreibetrieb
kunststofftechnik kunststoff
kurierdienst kurier-und-paketdienst paketdienst
labor laboratorium analytiklabor
landmaschinen landtechnik
malerbetrieb malerfachbetrieb maler
maschinenbau
messebau messestände
metzgerei fleischerei
modehaus fashion-house mode
möbelhaus einrichtungshaus möbel
musikschule musikunterricht
nachhilfeinstitut lerninstitut nachhilfe
optik augenoptik optiker
personalservice personaldienst zeitarbeit personaldienstleistung
pflegedienst ambulanter-pflegedienst
physiotherapie krankengymnastik physio
reisebüro reisen
restaurant speiserestaurant
sägewerk holzwerk
schreinerei tischlerei
seniorenheim altenheim pflegeheim
softwarehaus softwareentwicklung
spedition speditionsbetrieb
stahlbau metallbau
steuerberatung steuerkanzlei stb-kanzlei steuerberater
tankstelle tankhof
tierklinik tierarztpraxis tierarzt
umzüge umzugsservice umzugsdienst
verpackungen verpackungstechnik
versicherungsbüro versicherungsagentur
wachdienst sicherheitsdienst wach-und-sicherheitsdienst
wäscherei textilpflege waschsalon
weinhandel weinhaus
werkzeugbau
zahnarztpraxis zahnarzt
"""
TRADES = tuple(TRADES.strip().split("\n"))
# Words before a name.
BEFORE = frozenset("fa firma familienbetrieb inh inhaber inhaberin herr frau".split())
# Words of two letters that are no names; others are if there is no longer one.
NO_NAMES = frozenset("ab am an co da de di dr du el im in la nr of st um zu".split())
# Words before a place.
BRANCH = r"filiale|niederlassung|standort|zweigstelle|betriebsst\w+|zentrale|hauptsitz|nl|ndl"
LEGAL = re.compile(
    r"(?<!\w)(?:g\.?\s?m\.?\s?b\.?\s?h\.?\s*(?:&|\+|und|u\.)\s*co\.?\s*(?:k\.?\s?g\.?|ohg)?(?:aa)?"
    r"|(?:ug|unternehmergesellschaft)\s*\(?\s*haftungsb\w*\.?\s*\)?|\(?\s*haftungsb\w{4,}\.?\s*\)?|gesellschaft\s+mbh|gesellschaft\s+mit\s+beschr\w*\s+haftung|unternehmergesellschaft"
    r"|kommanditgesellschaft|aktiengesellschaft|offene\s+handelsgesellschaft|gesellschaft\s+bürgerlichen\s+rechts"
    r"|eingetragener\s+kaufmann|e\.?\s?kfm\.?|e\.?\s?kfr\.?|e\.?\s?k\.?|g\.?\s?m\.?\s?b\.?\s?h\.?|mbh|g\.?\s?b\.?\s?r\.?|o\.?\s?h\.?\s?g\.?|k\.?\s?g\.?(?:aa)?|a\.?\s?g\.?|u\.?\s?g\.?|e\.?\s?v\.?|se)(?!\w)",
    re.I,
)
# Legal forms written out, folded, for what the pattern misses by a slip.
LEGAL_WORDS = ["aktiengeselschaft", "komanditgeselschaft", "kommanditgeselschaft", "handelsgeselschaft", "unternehmergeselschaft"]
#: Logarithm of the chance of one typing slip.
SLIP = math.log(0.02)
#: Logarithm of the chance that another employer of the same line has a name one slip away.
COLLISION = math.log(3e-4)
#: A word that is learned as a line of business is in this share of the spellings whose line is unknown, so that there
#: are a few thousand at most whatever the corpus; it accompanies so many different names; and in this share of its
#: spellings it is the only word that does.
LINE_SHARE, LINE_NAMES, LINE_ALONE = 0.001, 8, 0.3
#: Share of the rarer word's names that two words of one line of business have in common.
LINE_OVERLAP = 0.5
_UML = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "é": "e", "è": "e", "á": "a", "à": "a", "ê": "e", "ô": "o", "ç": "c"})
_SS = re.compile("ss+")
_PIECE = re.compile(r"(?P<word>[^\W\d_]+\.?)|(?P<sep>[^\s])")
_ZERO = re.compile(r"(?<=[^\W\d_])0|0(?=[^\W\d_])")
_CAPITAL_I = re.compile(r"(?<=[a-zäöüß])I|(?<=[A-ZÄÖÜa-zäöüß])I(?=[a-zäöüß])")


def fold(text: str) -> str:
    """Lower case without umlauts, spelt out or not, and with every run of s as one."""
    return _SS.sub("s", text.lower().translate(_UML).replace("ae", "a").replace("oe", "o").replace("ue", "u"))


def plain(text: str) -> str:
    """Lower case without umlauts, what may spell one out left as it is."""
    return _SS.sub("s", text.lower().translate(_UML))


class Lines:
    """Words of lines of business, and the line that each names."""

    def __init__(self, lines: tuple[str, ...]) -> None:
        self.by_word: dict[str, str] = {}
        for line in lines:
            if names := line.split():
                for w in names:
                    self.by_word.setdefault(fold(w.replace("-", "")), fold(names[0]))
                    self.by_word.setdefault(plain(w.replace("-", "")), fold(names[0]))
        self.slips = Near(w for w in self.by_word if len(w) >= 5)
        self.seen: dict[tuple[str, bool, bool], str | None] = {}

    def of(self, span: str, abbreviated: bool, exact: bool) -> str | None:
        """The line of business that a run of words without blanks names; dots stand for letters left out."""
        key = (span, abbreviated, exact)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._of(*key)
        return self.seen[key]

    def _of(self, span: str, abbreviated: bool, exact: bool) -> str | None:
        if not abbreviated and span in self.by_word:
            return self.by_word[span]
        if abbreviated:
            hits = self.abbreviated(span)
            return hits.pop() if len(hits) == 1 else self.by_word.get(span.replace(".", ""))
        if exact or len(span) < 4:
            return None
        most = 1 if len(span) < 9 else 2
        near = [(d, w) for d, w in self.slips.of(span, most) if len(span) > 4 or span[0] == w[0]]
        return self.by_word[min(near)[1]] if near else None

    def abbreviated(self, span: str) -> set[str]:
        """The lines of whose word an abbreviation keeps the beginning of each part."""
        parts = span.split(".")
        if len(parts[0]) < 2 or len(span) < 4:
            return set()
        pattern = re.compile(r"\w*".join(map(re.escape, parts)))
        return {t for w, t in self.by_word.items() if pattern.fullmatch(w)}

    def shortened(self, span: str) -> set[str]:
        """The lines that an abbreviation may stand for: as above, else of whose word it is any subsequence that keeps the first two letters."""
        letters = span.replace(".", "")
        hits = self.abbreviated(span)
        if hits or len(letters) < 4:
            return hits
        pattern = re.compile(re.escape(letters[:2]) + r"\w*" + r"\w*".join(map(re.escape, letters[2:])) + r"\w*")
        return {t for w, t in self.by_word.items() if pattern.fullmatch(w)}

    def meant(self, span: str) -> set[str]:
        """The lines that an abbreviation may stand for: as above, else with one letter of it wrong, swapped or too many."""
        if hits := self.shortened(span):
            return hits
        letters = span.replace(".", "")
        if len(letters) < 7:
            return set()
        return {t for w, t in self.by_word.items() if w[0] == letters[0] and common(letters, w) >= len(letters) - 1}

    def abbreviated_slip(self, span: str) -> str | None:
        """As ``of`` for an abbreviation with one slip in it: its letters start a word, but for one edit."""
        parts = span.split(".")
        if len(parts) != 2 or parts[1] or len(parts[0]) < 4:
            return None
        if whole := self.of(parts[0], False, False):
            return whole
        n = len(parts[0])
        hits = {t for w, t in self.by_word.items() if len(w) > n and min(distance(parts[0], w[:k], 1) for k in (n - 1, n, n + 1)) <= 1}
        return hits.pop() if len(hits) == 1 else None


def common(a: str, b: str) -> int:
    """Length of the longest sequence of letters that both have in this order."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@functools.lru_cache(maxsize=8)
def lines_of(lines: tuple[str, ...]) -> Lines:
    return Lines(lines)


@functools.lru_cache(maxsize=8)
def _towns(places: frozenset[str]) -> Near:
    return Near(places)


def _without_place(s: str, places: frozenset[str]) -> str:
    """The spelling without a branch or town at its end."""
    s = re.sub(rf"[\s,(\-–/]+(?:{BRANCH})\b\.?\s+.*$", "", s, flags=re.I)
    if m := re.search(r"\s*\(([^()]*)\)\s*$", s):
        s = s[: m.start()]
    for m in reversed(list(re.finditer(r"\s*,\s+|\s+[-–|/]\s+", s))):
        tail = fold(s[m.end() :]).strip(" .")
        if tail and m.start() > 0 and _towns(places).has(tail):
            return s[: m.start()]
        break
    return s


def read_spelling(text: str, places: frozenset[str] = frozenset(), lines: tuple[str, ...] = TRADES) -> dict[str, object]:
    """What one spelling tells: ``trade`` (line of business) and ``names``, both may be empty; ``plain``: the names
    (without line of business, the words) with umlauts as typed; ``others``: other ways to read line and names, of
    which those in ``loose`` may have slips beside; ``words``: all words but the line of business.
    """
    known = lines_of(lines)
    s = tidy(html.unescape(text))
    s = _ZERO.sub("o", s)
    if any(c.islower() for c in s):
        s = _CAPITAL_I.sub("l", s)
    s = LEGAL.sub(" ", s)
    s = _without_place(s.strip(" ,"), places)
    s = LEGAL.sub(" ", s).strip(" ,-")
    words: list[str] = []
    breaks: list[bool] = []
    soft: list[bool] = []
    typed: dict[str, str] = {}
    marks: list[str] = []
    gap = dash = False
    for m in _PIECE.finditer(s):
        if m["sep"]:
            dash = m["sep"] in "-–"
            gap = True
            continue
        w = fold(m["word"])
        if w in ("und", "u.", "and") and words:
            words.append("und")
            marks.append("und")
            breaks.append(True)
            soft.append(False)
            gap, dash = True, False
            continue
        if w.rstrip(".") in BEFORE:
            gap = True
            continue
        if len(w) > 8 and (w.startswith("haftun") or any(distance(w.rstrip("."), x, 2) <= 2 for x in LEGAL_WORDS)):
            gap = True
            continue
        typed[w.rstrip(".")] = plain(m["word"].rstrip("."))
        marks.append(plain(m["word"]))
        words.append(w)
        breaks.append(gap)
        soft.append(dash)
        gap = dash = False
    trade, at = "", (0, 0)
    n = len(words)
    for exact in (True, False):
        for size in range(min(4, n), 0, -1):
            for i in range(n - size + 1):
                part = words[i : i + size]
                if part[0] == "und" or part[-1] == "und":
                    continue
                if size > 1 and "und" not in part and not all(soft[i + 1 : i + size]) and not exact and not (size == 2 and len(part[0]) > 6):
                    continue
                span, bare = "".join(part), "".join(marks[i : i + size])
                dotted = "." in span
                found = known.of(span, dotted, exact) or (known.of(bare, dotted, exact) if bare != span else None) or (known.abbreviated_slip(span) if dotted and not exact else None)
                if found:
                    trade, at = found, (i, i + size)
                    break
            if trade:
                break
        if trade:
            break
    if trade:
        lo, hi = at
        wider = [(i, j) for i in range(max(0, lo - 2), lo + 1) for j in range(hi, min(n, hi + 2) + 1) if j - i <= 4 and (i, j) != at]
        for i, j in sorted(wider, key=lambda x: x[0] - x[1]):
            part = words[i:j]
            if part[0] != "und" and part[-1] != "und" and ("und" in part or all(soft[i + 1 : j])):
                span = "".join(part)
                if found := known.of(span, "." in span, False):
                    trade, (lo, hi) = found, (i, j)
                    break
        while lo > 0 and soft[lo] and len(words[lo - 1]) <= 5:
            lo -= 1
        while hi < n and soft[hi] and len(words[hi]) <= 5:
            hi += 1
        at = (lo, hi)
    maybe: dict[tuple[int, int], set[str]] = {}
    if not trade:
        # An abbreviation that fits several lines, or none but with a slip: each is a hypothesis.
        for size in range(min(4, n), 0, -1):
            for i in range(n - size + 1):
                span = "".join(words[i : i + size])
                if "." in span and "und" not in words[i : i + size] and all(soft[i + 1 : i + size]) and (hits := known.meant(span)):
                    maybe[i, i + size] = hits

    def named(at: tuple[int, int], trade: str, least: int) -> tuple[list[list[str]], list[list[str]]]:
        """Runs of words of so many letters beside the line of business, cut at breaks, and with hyphens joined."""
        segments: list[list[str]] = [[]]
        joined: list[list[str]] = [[]]
        for i, w in enumerate(words):
            inside = at[0] <= i < at[1]
            if inside or w == "und" or breaks[i]:
                segments.append([])
                if inside or w == "und" or not soft[i]:
                    joined.append([])
            if not inside and w != "und":
                bare = w.rstrip(".")
                if len(bare) >= least and bare not in NO_NAMES and (not trade or known.of(bare, False, True) != trade):
                    segments[-1].append(bare)
                    joined[-1].append(bare)
        segments, joined = [x for x in segments if x], [x for x in joined if x]
        return (segments, joined) if segments or least == 2 else named(at, trade, 2)

    def ways(segments: list[list[str]], joined: list[list[str]]) -> list[list[str]]:
        """The names as read, with two words beside each other as one, and the last of each run with hyphens."""
        together = {"".join(x) if len(x) == 2 else x[-1] for x in segments}
        return [sorted({x[-1] for x in segments}), sorted(together), sorted({x[-1] for x in joined})]

    segments, joined = named(at, trade, 3)
    names, together, last = ways(segments, joined)
    beside = sorted({w for x in segments for w in x})
    key = lambda t, x: t + "|" + "&".join(x)
    loose = {key(trade, together)} if together != names else set()
    for span, hits in maybe.items():
        for t in hits:
            loose |= {key(t, x) for x in ways(*named(span, t, 3))[:2] if x}
    return {
        "trade": trade,
        "names": names,
        "plain": sorted(typed.get(x, x) for x in (names if trade else beside)),
        "others": sorted(loose | ({key(trade, last)} if last != names else set())),
        "loose": sorted(loose),
        "words": beside,
    }


def assign(cost: list[list[int]]) -> int:
    """The least total of a square table with one entry from each row and column (shortest augmenting paths)."""
    n = len(cost)
    u, v, row_of, came = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while row_of[j]:
            used[j] = True
            r, delta, nxt = row_of[j], math.inf, 0
            for k in range(1, n + 1):
                if not used[k]:
                    d = cost[r - 1][k - 1] - u[r] - v[k]
                    if d < least[k]:
                        least[k], came[k] = d, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    return sum(cost[row_of[k] - 1][k - 1] for k in range(1, n + 1))


def slip(a: str, b: str) -> int:
    """0 for one name, 1 for names one slip apart, else 2; a name of two letters has to be exact."""
    return 0 if a == b else distance(a, b, 1) if min(len(a), len(b)) > 2 else 2


def edits(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Slips between two name lists of one length in the best order, at most one in each name; else a large number."""
    if len(a) != len(b):
        return 99
    if a == b:
        return 0
    far = 99 * len(a)
    cost = [[d if (d := slip(x, y)) <= 1 else far for y in b] for x in a]
    return min(cost[0][0] if len(a) == 1 else assign(cost), 99)


def neighbours(names: tuple[str, ...]) -> set[str]:
    """Each name with up to one letter left out; names one slip apart share one."""
    out = set()
    for x in names:
        out.add(x)
        if len(x) > 2:
            out.update(x[:i] + x[i + 1 :] for i in range(len(x)))
    return out


def learn_lines(untold: DataFrame, told: DataFrame) -> tuple[str, ...]:
    """Lines of business, each with its words, from spellings (company, words) whose line is unknown.

    A learned word joins a known line, too, if most of its names have that line in the spellings ``told`` (trade, names).

    What comes to the driver are words that LINE_SHARE of these spellings have: a few thousand at most.
    """
    n = untold.count()
    if n < LINE_NAMES:
        return ()
    words = untold.select("company", F.explode("words").alias("word")).filter(F.length("word") > 2)
    many = words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= LINE_NAMES) & (F.col("n") >= LINE_SHARE * n))
    # The words are a bounded number (see above); how many of them a spelling has tells who stands alone.
    busy = cut(words.join(F.broadcast(many.select("word")), "word"))
    alone = busy.groupBy("company").agg(F.count("*").alias("k"), F.min("word").alias("word")).filter("k = 1").groupBy("word").agg(F.count("*").alias("alone"))
    beside = busy.join(words.withColumnRenamed("word", "name"), "company").filter("name != word").groupBy("word").agg(F.approx_count_distinct("name", 0.05).alias("names"))
    lines = many.join(alone, "word").join(beside, "word").filter((F.col("names") >= LINE_NAMES) & (F.col("alone") >= LINE_ALONE * F.col("n")))
    found = sorted((-r["n"], r["word"]) for r in lines.select("word", "n").collect())
    if not found:
        return ()
    chosen = F.broadcast(untold.sparkSession.createDataFrame([(w,) for _, w in found], "line string"))
    of_name = busy.join(chosen, F.col("word") == F.col("line")).select("company", "line").join(words.withColumnRenamed("word", "name"), "company").filter("name != line").join(chosen.withColumnRenamed("line", "name"), "name", "left_anti").select("name", "line")
    of_name = cut(of_name.unionByName(told.select(F.explode("names").alias("name"), F.col("trade").alias("line"))).distinct())
    size = {r["line"]: r["count"] for r in of_name.groupBy("line").count().collect()}
    a, b = of_name.alias("a"), of_name.alias("b")
    both = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.line") < F.col("b.line"))).groupBy(F.col("a.line").alias("x"), F.col("b.line").alias("y")).count().collect()
    fresh = {w: k for k, (_, w) in enumerate(found)}
    group = {w: w for w in (*fresh, *size)}
    # Known lines come first, and are never made one with each other.
    rank = {w: fresh.get(w, -1) for w in group}

    def top(w: str) -> str:
        while group[w] != w:
            w = group[w]
        return w

    for r in both:
        x, y = sorted((top(r["x"]), top(r["y"])), key=lambda w: (rank[w], w))
        if rank[y] >= 0 and r["count"] >= max(2, LINE_OVERLAP * min(size[r["x"]], size[r["y"]])):
            group[y] = x
    out: dict[str, list[str]] = {}
    for _, w in found:
        out.setdefault(top(w), []).append(w)
    return tuple(" ".join(dict.fromkeys((line, *ws))) for line, ws in out.items())


def link_employers(companies: DataFrame, places: list[str] | None = None, column: str = "company", lines: tuple[str, ...] = TRADES) -> DataFrame:
    """(company, employer, n_rows): each distinct spelling with the id of its employer; unreadable spellings have none."""
    ship(companies.sparkSession)
    towns = frozenset(fold(p) for p in places or [])
    texts = T.ArrayType(T.StringType())
    reading = T.StructType([T.StructField("trade", T.StringType())] + [T.StructField(k, texts) for k in ("names", "plain", "others", "loose", "words")])

    # The functions are marked nondeterministic where a filter follows: else they would run once more for the filter.
    def reader(known: tuple[str, ...]):  # noqa: ANN202
        @F.arrow_udf(reading)
        def read(company: pa.Array) -> pa.Array:
            got = [read_spelling(x or "", towns, known) for x in company.to_pylist()]
            return pa.array(got, pa.struct([("trade", pa.string())] + [(k, pa.list_(pa.string())) for k in ("names", "plain", "others", "loose", "words")]))

        return read.asNondeterministic()

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def near_names(names: pa.Array) -> pa.Array:
        return pa.array([sorted(neighbours(tuple(x or ()))) for x in names.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("int")
    def slips(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([edits(tuple(x), tuple(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    @F.arrow_udf("int")
    def within(names: pa.Array, words: pa.Array) -> pa.Array:
        """Slips by which all names are among the words, or a large number."""
        out = []
        for x, y in zip(names.to_pylist(), words.to_pylist(), strict=True):
            best = [min(slip(a, b) for b in y) for a in x]
            out.append(sum(best) if max(best) <= 1 else 99)
        return pa.array(out, pa.int32())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def beside(names: pa.Array, words: pa.Array) -> pa.Array:
        """The words that are none of the names, not even with a slip."""
        pairs = zip(names.to_pylist(), words.to_pylist(), strict=True)
        return pa.array([[b for b in y if len(b) > 2 and all(slip(a, b) > 1 for a in x)] for x, y in pairs], pa.list_(pa.string()))

    distinct = companies.filter(F.length(F.trim(column)) > 0).groupBy(F.col(column).alias("company")).agg(F.count("*").alias("n_rows"))
    first = cut(distinct.withColumn("r", reader(tuple(lines))("company")).select("company", "n_rows", "r.*").filter(F.size("names") > 0))
    learned = learn_lines(first.filter("trade = ''").select("company", "words"), first.filter("trade != ''").select("trade", "names"))
    if learned:
        again = first.filter("trade = ''").select("company", "n_rows").withColumn("r", reader((*lines, *learned))("company")).select("company", "n_rows", "r.*").filter(F.size("names") > 0)
        first = first.filter("trade != ''").unionByName(again)
    spellings = cut(first.withColumn("key", F.when(F.col("trade") == "", F.concat(F.lit("|"), F.array_join("words", "&"))).otherwise(F.concat_ws("|", "trade", F.array_join("names", "&")))))
    keys = spellings.groupBy("key").agg(F.any_value("trade").alias("trade"), F.any_value("names").alias("names"), F.any_value("words").alias("words"), F.sum("n_rows").alias("n_rows"))
    keys = cut(keys.select("key", "trade", (F.col("trade") == "").alias("unknown"), F.log("n_rows").alias("prior"), F.when(F.col("trade") == "", F.col("words")).otherwise(F.col("names")).alias("form")))
    # What is compared are a reading's names (without line of business, its words), folded and in each way that their
    # umlauts were typed; and, with its line, each other way to read them.
    typed = spellings.select("key", F.col("plain").alias("form")).distinct().join(keys.select("key", "trade", "unknown", "prior"), "key")
    forms = keys.unionByName(typed).distinct().withColumn("other", F.lit(False))
    others = (
        spellings.select("key", F.explode("loose").alias("other")).distinct().join(keys.select("key", "unknown", "prior"), "key")
        .select("key", F.substring_index("other", "|", 1).alias("trade"), "unknown", "prior", F.split(F.substring_index("other", "|", -1), "&").alias("form"), F.lit(True).alias("other"))
    )
    tokens = forms.unionByName(others).withColumn("name", F.explode("form")).withColumn("n_names", F.size("form")).withColumn("near", F.explode(near_names(F.array("name"))))
    # Of several names each has to meet, so the rarest of a reading is enough to find all: a common one forms no pairs.
    block = ["trade", "n_names", "near"]
    several = tokens.filter("n_names > 1")
    seldom = (
        several.join(several.filter(~F.col("other")).groupBy(*block).agg(F.count("*").alias("n")), block)
        .groupBy("key", "trade", "form", "name").agg(F.sum("n").alias("n")).groupBy("key", "trade", "form").agg(F.min_by("name", F.struct("n", "name")).alias("name"))
    )
    a = tokens.filter("n_names = 1").unionByName(several.join(seldom, ["key", "trade", "form", "name"])).alias("a")
    b = tokens.filter(~F.col("other")).alias("b")
    before = (F.col("b.prior") > F.col("a.prior")) | ((F.col("b.prior") == F.col("a.prior")) & (F.col("b.key") < F.col("a.key")))
    met = (F.col("a.trade") == F.col("b.trade")) & (F.col("a.near") == F.col("b.near")) & (F.col("a.n_names") == F.col("b.n_names")) & (F.col("a.key") != F.col("b.key"))
    pick = [F.col(f"{t}.{c}").alias(n) for t, c, n in (("a", "key", "key"), ("b", "key", "candidate"), ("a", "other", "other"), ("a", "form", "names"), ("b", "form", "meant"), ("a", "prior", "mine"), ("b", "prior", "prior"))]
    pick.append((F.col("a.unknown") & ~F.col("b.unknown")).alias("up"))
    pairs = (
        a.join(b, met & (F.col("a.other") | before)).select(*pick).dropDuplicates(["key", "candidate", "other", "names", "meant"])
        .withColumn("slips", slips.asNondeterministic()("names", "meant")).filter(F.col("slips") <= F.size("names"))
        .groupBy("key", "candidate", "other").agg(F.min("slips").alias("slips"), F.any_value("mine").alias("mine"), F.any_value("prior").alias("prior"), F.any_value("up").alias("up"))
        # Two readings are a slip apart at least, also where folding has taken it away.
        .withColumn("slips", F.when(F.col("other"), F.col("slips")).otherwise(F.greatest("slips", F.lit(1))))
        .filter((F.col("slips") == 0) | (F.when(F.col("up"), F.col("prior")).otherwise(F.greatest("prior", "mine")) + F.col("slips") * (SLIP - COLLISION) > 2 * F.when(F.col("up"), F.col("mine")).otherwise(F.least("prior", "mine"))))
    )
    pairs = cut(pairs.select("key", "candidate", "other", (F.col("slips") * SLIP + F.when(F.col("other"), SLIP).otherwise(0.0)).alias("cost")))
    # Other ways that have to be exact.
    exact = (
        spellings.filter("trade != ''").select("key", F.explode("others").alias("candidate")).distinct().filter("candidate != key")
        .join(keys.select(F.col("key").alias("candidate")), "candidate").select("key", "candidate", F.lit(SLIP).alias("cost"))
    )
    # All links go from unknown to known lines, then to the more frequent reading, then to the one that more others are
    # near, then to the one that sorts first: no circles.
    met_by = pairs.filter(~F.col("other")).select(F.explode(F.array("key", "candidate")).alias("key")).groupBy("key").agg(F.count("*").alias("near"))
    rank = cut(keys.select("key", "unknown", "prior").join(met_by, "key", "left").select("key", F.struct("unknown", (-F.col("prior")).alias("prior"), (-F.coalesce("near", F.lit(0))).alias("near"), "key").alias("rank")))
    ways = (
        pairs.select("key", "candidate", "cost").unionByName(exact)
        .join(rank.withColumnRenamed("rank", "x"), "key").join(rank.select(F.col("key").alias("candidate"), F.col("rank").alias("y")), "candidate")
        .select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "cost")
        .select(F.col("x.key").alias("key"), F.col("x.unknown").alias("unknown"), F.struct(F.col("y.unknown"), (F.col("y.prior") - F.col("cost")).alias("posterior"), F.col("y.near"), F.col("y.key")).alias("parent"))
        .groupBy("key", "unknown").agg(F.min("parent").alias("parent"))
    )
    ways = cut(ways)

    def ends(links: DataFrame) -> DataFrame:
        """Each key's link followed to its end."""
        while True:
            up = links.select(F.col("key").alias("parent"), F.col("parent").alias("grand"))
            jumped = cut(links.join(up, "parent").select("key", "parent", "grand"))
            moved = not jumped.filter("parent != grand").isEmpty()
            links = jumped.select("key", F.col("grand").alias("parent"))
            if not moved:
                return links

    parents = ways.filter(~F.col("unknown")).select("key", F.col("parent.key").alias("parent"))
    links = ends(cut(keys.filter("trade != ''").select("key").join(parents, "key", "left").select("key", F.coalesce("parent", "key").alias("parent"))))
    untold = forms.filter("unknown").select("key", F.col("form").alias("words"))
    if untold.isEmpty():
        return spellings.join(links, "key").select("company", F.col("parent").alias("employer"), "n_rows")
    # Spellings whose line was not read: where one employer has these names, and what is left are first names, which
    # are the words that spellings of known lines have beside two different names or more.
    first_names = (
        spellings.filter("trade != ''").select("key", F.explode(F.array_except("words", "names")).alias("word")).distinct()
        .groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2").select("word")
    )
    near_words = untold.select("key", "words", F.explode(near_names(F.col("words"))).alias("near"))
    meant = forms.filter(~F.col("unknown")).select(F.col("key").alias("candidate"), F.col("form").alias("meant"), "prior", F.explode(near_names(F.slice("form", 1, 1))).alias("near"))
    fits = cut(
        near_words.join(meant, "near").drop("near").dropDuplicates(["key", "candidate", "words", "meant"])
        .withColumn("slips", within.asNondeterministic()("meant", "words")).filter("slips < 99")
        .withColumn("left", beside("meant", "words")).withColumn("size", F.size("meant"))
        .groupBy("key", "candidate", "size", "prior").agg(F.min("slips").alias("slips"), F.min_by("left", F.struct("slips", "left")).alias("left"))
    )
    strange = fits.select("key", "candidate", F.explode("left").alias("word")).join(first_names, "word", "left_anti").select("key", "candidate").distinct()
    # Readings that are linked are one employer.
    by_size = (
        fits.join(strange, ["key", "candidate"], "left_anti").join(links.withColumnRenamed("key", "candidate"), "candidate")
        .groupBy("key", (F.col("size") * 100 - F.col("slips")).alias("fit"))
        .agg(F.max(F.struct("prior", "slips", "candidate")).alias("c"), (F.min("parent") == F.max("parent")).alias("one"))
    )
    joined = (
        by_size.groupBy("key").agg(F.max_by(F.struct("c", "one"), "fit").alias("b")).filter("b.one")
        .select("key", F.struct(F.lit(False).alias("unknown"), (-F.col("b.c.prior") - SLIP).alias("posterior"), F.lit(0).cast("long").alias("near"), F.col("b.c.candidate").alias("key")).alias("parent"))
    )
    best = ways.filter("unknown").select("key", "parent").unionByName(joined).groupBy("key").agg(F.min("parent").alias("parent"))
    told = links.unionByName(keys.filter("unknown").select("key").join(best, "key", "left").select("key", F.coalesce("parent.key", "key").alias("parent")))
    return spellings.join(ends(cut(told)), "key").select("company", F.col("parent").alias("employer"), "n_rows")


def employer_pairs(linked: DataFrame) -> DataFrame:
    """Each pair of spellings of one employer, the smaller first: the expanded form of :func:`link_employers`."""
    a, b = linked.alias("a"), linked.alias("b")
    return a.join(b, (F.col("a.employer") == F.col("b.employer")) & (F.col("a.company") < F.col("b.company"))).select(F.col("a.company").alias("company_a"), F.col("b.company").alias("company_b"))
