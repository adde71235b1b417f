"""Sentence boundaries across languages and scripts, as offsets in code points.

A text is first laid out into blocks: lines, list items (without their markers) and headings are blocks of their own,
the lines of a wrapped paragraph are one block. Over each block runs a pushdown automaton: quotation marks and
brackets push and pop, and only the bottom of the stack may end a sentence; an opener that its block never closes is
an ordinary character. At the bottom, terminators of any script end a sentence unless a trie of abbreviations, read
backwards from the full stop, an ordinal, a date, an initial or what follows says otherwise.

Defined results: null, empty and blank texts have no sentences; texts of any length are read whole; a byte-order mark
belongs to no sentence. Repeated texts give equal rows under each id; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Abbreviations that never end a sentence (titles, and words that need what follows).
NEVER = """
dr prof hr hrn fr frl mr mrs ms mme mlle dipl ing mag st skt nr no nos num tel fax ca circa z.b z. b d.h u.a i.d.r v.h i.h.v
vgl ziff abs art gem geb inh zzgl inkl exkl mind max min evtl ggf bzw rechtl bspw sog gegr gez hrsg jmd jmdn jdn jmds co str
s o.ä o.g u.ä z.t z.hd i.a i.v p.p dipl.-ing mo di mi do sa allg bes betr einschl entspr erf kfm lfd mtl stellv techn
cf vs est approx sec e.g i.e fig vol dept gen sgt capt rev jr messrs
env ex p.ex c.-à-d art al bd av boul mgr m n°
ok np tj ul al godz kat p pl os woj im ks inż
örn av yrd doç sok cad mah apt bkz
ок напр тел ул д стр г-н г-жа см т.е пр пл им рис кв корп обл
डॉ प्रो श्री
""".split()
# Abbreviations that end a sentence if a new one visibly starts.
MAYBE = "usw usf etc u.v.m u.v.a p.a a.m p.m ltd inc corp plc e.k e.v a.g g.b.r o.h.g k.g std stk mio mrd tsd jh r vb itp itd г гг т.д т.п руб u.s u.k".split()
# Months and nouns that ordinals stand before; words that ordinals stand after.
ORDINAL_NOUNS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez tag tage tages woche monat monats monate jahr jahres jahrhundert semester semesters generation stock stockwerk etage obergeschoss quartal klasse lehrjahr ausbildungsjahr schicht stufe platz mal lebensjahr halbjahr hälfte kapitel auflage bezirk advent".split()
)
BEFORE_ORDINAL = frozenset("dem den der des das die am zum zur vom im ab bis seit jeden jeder jedem in beim ein einem einen".split())
BEFORE_CARDINAL = frozenset("nr no ziff abs art raum zimmer halle tor gleis haus seite nummer kennziffer stufe klasse geb nummer budynek nr sec room".split())
PAIRS = {"„": "“”", "“": "”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "‚": "‘", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "〈": "〉", "《": "》", '"': '"', "＂": "＂"}
QUOTES = frozenset("„“«»‹「『‚\"＂〈《")
CLOSERS = frozenset("“”»«›」』‘)]}）】］〉》\"＂")
HARD = "。！？।॥؟！？۔｡!?"
NO_CASE_STOPS = frozenset("。！？।॥۔｡")
MARKER = re.compile(r"[ \t\u00a0\ufeff]*(?:[-–—*•→▪·✅▸►‣○●◦■□✓✔☑✗➤➔»][ \u00a0\t]+|\(?(\d{1,3})[.)][ \u00a0\t]+|[a-zA-Z]\)[ \u00a0\t]+)(?=\S)")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_EVENT = re.compile(r"(?P<stop>[.!?…。！？।॥؟۔｡]+)|(?P<smile>[:;]-?[)D(]|[\U0001F300-\U0001FAFF\u263a\u2639]\ufe0f?)|(?P<thai>(?<=[\u0e01-\u0e5b])\s+(?=[\u0e01-\u0e5b]))")
_THAI = re.compile("[\u0e01-\u0e5b]")
#: What an event begins with where there is no Thai: one set of characters, which is found fast.
_FIRST = re.compile("[.!?…。！？।॥؟۔｡:;\U0001F300-\U0001FAFF\u263a\u2639]")
_MARKS = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + "]")
_LAST = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])[\w\u0300-\u036f\u0900-\u097f’°-]*(?:\.\s?[\w\u0300-\u036f-]+)*$")
_NUMBER = re.compile(r"(?:^|(?P<lead>[^\W\d_]+\.?|[:,;(：，；、（]|\S)\s*)(?P<n>\d+)$")
_GAP = re.compile(r"[.\s]")
_DATE = re.compile(r"(?<![\d.])\d{1,2}\.\d{1,2}$")


class _Trie:
    """Abbreviations, read backwards."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def ends(self, text: str, end: int, start: int) -> bool:
        """Whether an abbreviation, from a word's start on, ends at ``end``; blanks after inner dots don't count."""
        node, i = self.root, end
        while True:
            if "" in node and (i == start or not (text[i - 1].isalnum() or unicodedata.combining(text[i - 1]) or text[i - 1] in ".-")):
                return True
            if i > start and text[i - 1].isspace() and i > start + 1 and text[i - 2] == "." and i < end:
                i -= 1
                continue
            if i == start:
                return False
            node = node.get(text[i - 1].lower())
            if node is None:
                return False
            i -= 1


_NEVER, _MAYBE = _Trie(NEVER), _Trie(MAYBE)


#: Lines of less than so many characters are no wrapped text: verses, lists, addresses.
NARROW = 30


def _wrapped(lines: list[str]) -> int:
    """The width at which the lines were wrapped, or 0."""
    width = max(map(len, lines), default=0)
    if width < NARROW:
        return 0
    full = 0
    for a, b in zip(lines, lines[1:], strict=False):
        if a and b:
            first = b.split(None, 1)[0] if b.strip() else ""
            room = len(a.rstrip()) + 1 + len(first)
            # Without blanks ("first" is a whole line) any place would do to break, so a full line tells nothing.
            if room > width and len(first) < NARROW and first[:1] < "\u2e80" and not MARKER.match(b) and len(a) > width - 25:
                if not re.search(r"[.!?:。！？।؟]\s*$", a) and (b[0].islower() or not b[0].isupper()) or re.search(r"[,;(–]$|[a-zäöüß]$", a.rstrip()) and len(a) > width * 0.75 and not a.rstrip().endswith(")"):
                    full += 1
    return width if full else 0


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each block."""
    at, spans = 0, []
    for m in BREAK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    lines = [text[s:e] for s, e in spans]
    width = _wrapped(lines)
    start = end = -1
    number = 0
    for k, (s, e) in enumerate(spans):
        line = lines[k]
        if not line.strip():
            if start >= 0:
                yield start, end
            start, number = -1, 0
            continue
        marker = MARKER.match(line)
        joined = False
        if start >= 0 and width:
            above = lines[k - 1].rstrip()
            room = len(above) + 1 + len(line.split(None, 1)[0])
            joined = room > width
        if marker and marker[1]:
            n = int(marker[1])
            if joined or not (n == 1 or n == number + 1 or start < 0):
                marker = None
        elif marker and joined:
            marker = None
        if marker:
            if start >= 0:
                yield start, end
            number = int(marker[1]) if marker[1] else 0
            start, end = s + marker.end(), e
            if not width:
                yield start, end
                start = -1
            continue
        if start >= 0 and joined:
            end = e
            continue
        if start >= 0:
            yield start, end
        start, end, number = s, e, 0
        if not width:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


def _outermost(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets that are in no other, as (opener, closer)."""
    stack: list[tuple[str, int]] = []
    # How many open marks each closing mark would close.
    awaited = dict.fromkeys("".join(PAIRS.values()), 0)
    pairs: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, lo, hi):
        c, i = m[0], m.start()
        depth = next((d for d in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[d][0]]), None) if awaited.get(c) else None
        if depth is not None:
            if c == ")" and i > lo and text[i - 1] in "-:;" and stack[depth][0] == "(" and text[i - 2 : i] in (":-", ";-"):
                continue
            pairs.append((stack[depth][1], i))
            for o, _ in stack[depth:]:
                for x in PAIRS[o]:
                    awaited[x] -= 1
            del stack[depth:]
        elif c in PAIRS:
            stack.append((c, i))
            for x in PAIRS[c]:
                awaited[x] += 1
    pairs.sort()
    out: list[tuple[int, int]] = []
    for p in pairs:
        if not out or p[0] > out[-1][1]:
            out.append(p)
    return out


def _starts_new(text: str, i: int, hi: int) -> str:
    """What stands at ``i``: 'upper', 'lower', 'nocase', 'digit', 'mark' or 'end'."""
    if i >= hi:
        return "end"
    c = text[i]
    if c.isdigit():
        return "digit"
    if c.isalpha():
        if c.islower():
            return "upper" if any(x.isupper() for x in text[i + 1 : min(i + 3, hi)]) else "lower"
        return "upper" if c.isupper() or c.istitle() else "nocase"
    if c in QUOTES or c in "([{（¿¡":
        i += 1
        while i < hi and text[i].isspace():
            i += 1
        inner = _starts_new(text, i, hi)
        return "upper" if inner in ("upper", "digit", "nocase") else inner
    if c in "+€$£§#@*✅":
        return "digit"
    return "mark"


def _next_event(text: str, i: int, hi: int) -> re.Match[str] | None:
    while c := _FIRST.search(text, i, hi):
        if m := _EVENT.match(text, c.start(), hi):
            return m
        i = c.end()
    return None


def split_block(text: str, lo: int, hi: int, thai: bool = True) -> Iterator[tuple[int, int]]:
    """The sentences of one block; ``thai`` says whether the text may have Thai letters."""
    while lo < hi and (text[lo].isspace() or text[lo] == "\ufeff"):
        lo += 1
    event = _EVENT.search if thai else _next_event
    spans: list[tuple[int, int]] | None = None
    k = 0
    begin = i = lo
    while True:
        m = event(text, i, hi)
        if m is None or m.end() == hi:
            # Nothing follows that could be a sentence of its own.
            break
        if spans is None:
            spans = _outermost(text, lo, hi)
        s, e = m.span()
        while k < len(spans) and spans[k][1] < s:
            k += 1
        i = e
        if k < len(spans) and spans[k][0] < s:
            o, c = spans[k]
            # Inside: only a terminator right before the closing mark can end the sentence, after the mark.
            last = text[o + 1 : c].rstrip()
            i = c + 1
            ends_inside = last and last[-1] in ".!?…" + HARD
            if not ends_inside or (text[o] not in QUOTES and o != begin):
                continue
            while i < hi and text[i] in CLOSERS and not (k + 1 < len(spans) and spans[k + 1][0] == i):
                i += 1
            nxt = i
            while nxt < hi and text[nxt].isspace():
                nxt += 1
            kind = _starts_new(text, nxt, hi)
            lead = text[begin:o].rstrip()
            if kind == "nocase":
                split = bool(lead) and text[nxt] not in "とっっての"
            else:
                split = kind in ("upper", "digit") or kind == "end"
            if nxt < hi and text[nxt] in ".!?。！？":
                continue
            if split:
                yield begin, i
                begin = i = nxt
            continue
        if m["thai"]:
            yield begin, s
            begin = e
            continue
        nxt = e
        while nxt < hi and text[nxt] in CLOSERS and not any(o == nxt for o, _ in spans[k : k + 2]):
            nxt += 1
        end = nxt
        while nxt < hi and text[nxt].isspace():
            nxt += 1
        spaced = nxt > end
        kind = _starts_new(text, nxt, hi)
        if m["smile"]:
            if spaced and kind in ("upper", "digit", "nocase"):
                yield begin, end
                begin = i = nxt
            continue
        run = m[0]
        if kind == "end":
            break
        if run[-1] in NO_CASE_STOPS:
            split = kind != "mark" or text[nxt] not in "、，,;；:：—–-"
        elif run == "…" * len(run) or set(run) <= {".", "…"} and len(run) > 1:
            split = spaced and kind in ("upper", "digit") and s > begin
        elif "!" in run or "?" in run or "؟" in run:
            split = kind in ("upper", "nocase") or (spaced and kind == "digit")
        else:
            split = _full_stop(text, begin, s, nxt, hi, kind, spaced)
        if split:
            yield begin, end
            begin = i = nxt
    while hi > begin and text[hi - 1].isspace():
        hi -= 1
    if hi > begin:
        yield begin, hi


def _word_before(text: str, begin: int, dot: int) -> re.Match[str] | None:
    """The word that ends at ``dot``: looked for in a few characters, and in more where one run of letters fills them.

    Of words with inner full stops only the last part and that there are others matter, so that a chain of them is not
    followed back: the work is in proportion to the text.
    """
    size = 40
    while True:
        lo = max(begin, dot - size)
        m = _LAST.search(text, lo, dot)
        whole = m is not None and (m.start() > lo or "." in m[0])
        if lo == begin or whole or (m is None and _GAP.search(text, lo, dot)):
            return m
        size *= 4


def _full_stop(text: str, begin: int, dot: int, nxt: int, hi: int, kind: str, spaced: bool) -> bool:
    """Whether the full stop at ``dot`` ends a sentence, ``nxt`` being what follows."""
    if kind == "mark" or dot == begin:
        return False
    before = text[dot - 1]
    if before.isdigit():
        if not spaced and kind == "digit":
            return False
        # The words that matter before a number are short; a longer one is none of them, seen whole or not.
        head = text[max(begin, dot - 40) : dot]
        if _DATE.search(head):
            word = re.search(r"([^\W\d_]+)\s+\d{1,2}\.\d{1,2}$", head)
            return kind in ("upper", "digit") and not (word and word[1].lower() in BEFORE_ORDINAL)
        m = _NUMBER.search(head)
        if m is None or len(m["n"]) > 2 or (m["lead"] or "")[-1:] in "/-.+" and m["lead"]:
            return kind in ("upper", "nocase") or (spaced and kind == "digit")
        lead = unicodedata.normalize("NFC", (m["lead"] or "")).lower()
        if not lead or lead in ":,;(：，；、（":
            return False
        if kind == "lower":
            return False
        word = re.match(r"[\w\u0300-\u036f]+", text[nxt:hi])
        following = unicodedata.normalize("NFC", word[0]).lower() if word else ""
        if lead.rstrip(".") in BEFORE_CARDINAL:
            return True
        if following in ORDINAL_NOUNS or lead.rstrip(".") in BEFORE_ORDINAL:
            return False
        return kind in ("upper", "nocase", "digit")
    if not spaced:
        # Without a blank only an ordinary word before and a word after make an end.
        if kind == "digit" or kind == "lower" or kind == "mark":
            return False
        word = _word_before(text, begin, dot)
        tail = text[nxt + 1 : nxt + 2]
        if word and (len(word[0]) < 3 or "." in word[0] or word[0][:1].isupper() and len(word[0]) < 4):
            return False
        if kind == "upper" and tail == ".":
            return False
    if _MAYBE.ends(text, dot, begin):
        return kind in ("upper", "digit", "nocase")
    if _NEVER.ends(text, dot, begin):
        return False
    word = _word_before(text, begin, dot)
    letters = unicodedata.normalize("NFC", word[0]).rpartition(".")[2].strip() if word else ""
    if letters.lower().endswith("str") and len(letters) > 3:
        return False
    if len(letters) == 1 and letters.isalpha() and not ("぀" <= letters <= "鿿"):
        return False
    if kind == "lower":
        return len(letters) > 4 and letters[-1].islower() or (not letters and before in "%€)“”»\"'")
    return True


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text, in order."""
    if not text:
        return []
    out = []
    thai = not text.isascii() and _THAI.search(text) is not None
    for lo, hi in blocks(text):
        for s, e in split_block(text, lo, hi, thai):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                out.append((s, e))
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of each sentence."""
    schema = T.StructType([df.schema[key], T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few at a time: texts of any length, and their sentences, are in memory at once.
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                at: list[int] = []
                starts: list[int] = []
                ends: list[int] = []
                for k, t in enumerate(part.column(1)):
                    for s, e in sentences(t.as_py()):
                        at.append(k)
                        starts.append(s)
                        ends.append(e)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[name, "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, schema)
