"""Lines of job pages: the ad, the page around it, error notices, and residue of templates.

One linear classifier on hashed n-grams (:mod:`hashed`) scores each line as ad, page, notice or residue. Its labels
are weak and come from the data: where the same posting was also seen as bare text (a search result), lines of the
page that are in that text are the ad's, the others the page's; bare texts that are short and carry a response status
or a known phrase are notices; placeholders and filler phrases are residue. It is fitted at run time on a bounded,
documented number of pages (``SAMPLE_PAGES``), chosen by a hash of their id, and scores every line of every page.

*Main body* (:func:`body_lines`): pages interrupt ads, so the lines of a page form runs: the most probable path
through the states ad and page, with a price for each change, decides each line.

*Residue* (:func:`residue`): a page is reported if the classifier finds residue in a line (where its odds are near even,
an exact check of the page's placeholders decides), or if it has a notice and no line of an ad on the most probable path.

Defined results: null, empty and blank texts have no lines of either kind and are no residue; blank lines are never
reported; texts of any length are read whole; without any pages to learn from nothing is reported; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.llm import hashed
from stellwerk.llm.render import rendered
from stellwerk.llm.samples import distinct_texts
from stellwerk.session import cut, ship

AD, PAGE, NOTICE, RESIDUE = range(4)
#: Pages that the classifier is fitted on, at most.
SAMPLE_PAGES = 6000
#: Price of a change between ad and page along a page's lines, in log-odds.
CHANGE = 0.75
#: Pairs of a few words of ads, without and with residue, that the classifier is fitted on beside whole lines.
FEW = 8000
#: Log-odds above which a line says residue; and above which so many words of it, wherever they stand, are checked
#: exactly, so that a placeholder is not outvoted by the line around it.
SURE, DOUBT, WORDS = 2.0, 0.5, 3

# Names of fields that templates have placeholders for.
FIELDS = "firma firmenname company unternehmen arbeitgeber ort stadt city place location standort name vorname nachname gehalt salary lohn preis price vergütung telefon phone url link plz zip datum date start beginn kontakt contact email e-mail mail ansprechpartner abteilung bereich department benefits stelle stellentitel stellenbezeichnung job job_title jobtitle titel title position aufgaben tasks anrede text adresse address"
_FIELD = "(?:" + "|".join(map(re.escape, FIELDS.split())) + ")"
#: Unfilled placeholders in the notations of common template languages.
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.]+\s*\}?\}\}|\{%-?\s*[\w. ]+\s*-?%\}|\$\{\s*[\w.]+\s*\}|%%\w+%%|%\(\w+\)[sd]|@@\w+@@|\[\[\s*[\w. ]+\s*\]\]|<<\s*[\w. ]+\s*>>|__[^\W_]\w*?__|_{5,}|\{\d\}|#[^\W\d]\w*#(?!\w)"
    rf"|\$[A-Za-z]\w+\$?|%{_FIELD}%|\{{{_FIELD}\}}|\[(?:[^\[\]]{{0,20}}\s)?{_FIELD}(?:\s(?:eintragen|einfügen|ergänzen|einsetzen))?\]|\[[^\[\]]{{1,30}}\s(?:eintragen|einfügen|ergänzen|einsetzen)\]|<(?:Name der )?{_FIELD}>|«{_FIELD}»|&lt;{_FIELD}&gt;"
    # A missing value written out; "null" is a German word, too, which idioms have.
    r"|(?<!\w)X{4,}(?!\w)|(?<![\w.])(?:undefined|NaN)(?![\w.])|(?<=[:,] )None(?!\w)|(?<![\w.-])null(?![\w.-])(?!\s+(?:Toleranz|Problem|Bock|Fehler|Prozent|Uhr|Grad|auf|bis|Komma)\b)",
    re.I | re.M,
)
#: Mentions of the notation, in the running text of an ad.
_MENTION = re.compile(r"(?:\bwie|\bnamens|\bSyntax|\bAusdrücke\w*|\bsog\w*|\bz\. ?B\.)\s+[„\"'(]*$", re.I)
# Neighbouring keys, from the beginning of a row or of its right half, as typed for fun.
_TYPED = "(?:qwer[a-zü]*|asdf[a-zöä]*|yxcv[bnm]*|zxcv[bnm]*|uiop[ü]?|hjkl[öä]*|jklö[ä]?)"
FILLER = re.compile(
    rf"\b(?:Mustertext|Blindtext|Beispieltext|Platzhaltertext|Fülltext|Dummy ?text)\b(?!e)|\blorem ipsum\b|\bsample text\b|\bbla bla\b|(?:\btest\b\W*){{3}}|\bTODO\b|\bTBD\b|\b{_TYPED}\b(?:\W+\w+){{0,2}}$"
    r"|^\W*Text folgt\W*$|\bhier (?:steht demnächst|kommt noch|folgt (?:demnächst|noch))|\b(?:before publishing|do not publish|nicht veröffentlichen|vor (?:der )?Veröffentlichung ersetzen)\b",
    re.I | re.M,
)
STATUS = re.compile(
    r"\bHTTP \d{3}\b|\b(?:Fehler|Error|Code|Status)\W{0,2}[45]\d\d\b|\b[45]\d\d\W{1,3}(?:Seite|Not|Forbidden|Bad|Service|Gateway|Internal)|Internal server error|Gateway timeout|Bad gateway|NullPointer|Traceback|stack ?trace|Too many requests|Access denied|Forbidden|Service temporarily|Request id",
    re.I,
)
WALL = re.compile(
    r"nicht (?:mehr )?(?:gefunden|verfügbar|erreichbar|gültig|vorhanden|online)|existiert nicht|nicht gefunden werden|wurde (?:entfernt|gelöscht|deaktiviert|blockiert)|abgelaufen|JavaScript|Skripte|scripts? and cookies|Sicherheitsprüfung|kein Roboter|melden Sie sich an|loggen Sie sich|Zugriff verweigert|Wartungsarbeiten|zu viele Anfragen|schiefgelaufen|nur für angemeldete|not available|no longer available|page not found|log ?in to|sign in to|captcha|Browser wird nicht unterstützt|später erneut|try again later",
    re.I,
)


_HINT = re.compile(r"[{\[<«$%@#_]|&lt;|XXXX|undefined|null|None|NaN", re.I)


def unfilled(text: str) -> bool:
    """Whether a text has an unfilled placeholder, other than one that an ad mentions as such."""
    return bool(_HINT.search(text)) and any(not _MENTION.search(text[max(0, m.start() - 40) : m.start()]) for m in PLACEHOLDER.finditer(text))


def _strip(line: str) -> str:
    return line.strip()


def weak_labels(page: str, bare: str, title: str | None = None) -> list[int]:
    """A label for each line of a page by the posting's bare text, -1 where there is none."""
    lines = [_strip(x) for x in page.split("\n")]
    inner = [x for x in (_strip(y) for y in bare.split("\n")) if x]
    if title and title.strip() in inner[1:3]:
        # What stands before the title of a bare text is the site's, too.
        inner = inner[inner.index(title.strip()) :]
    labels = [-1] * len(lines)
    if not inner:
        return labels
    within = set(inner)
    long = [x for x in inner if len(x) > 25]
    short = len(bare) < 700 and len(inner) <= 8
    notice = short and any(STATUS.search(x) or WALL.search(x) for x in inner) and not any(len(x) > 60 and not (STATUS.search(x) or WALL.search(x)) for x in inner)
    at = [k for k, x in enumerate(lines) if x in within or any(y in x for y in long)]
    if not at:
        return labels
    whole = inner[-1] in lines or any(inner[-1] in x for x in lines if len(inner[-1]) > 25)
    hit = set(at)
    for k, x in enumerate(lines):
        if not x:
            continue
        if FILLER.search(x) or unfilled(x):
            labels[k] = RESIDUE
        elif k in hit:
            labels[k] = (AD if re.search(r"[(\[{][\w /|*]{1,11}[)\]}]$", x) else NOTICE) if notice else AD
        elif k < at[-1] or whole:
            labels[k] = PAGE
    if any(FILLER.search(x) for x in inner) and all(labels[k] in (RESIDUE, AD) for k in at):
        # A body of filler: what stands in it beside the phrases is filler too, but for its title.
        if sum(1 for x in inner if FILLER.search(x)) * 2 >= len(inner) - 1:
            for k in at:
                if labels[k] == AD and len(lines[k]) > 45:
                    labels[k] = RESIDUE
    return labels


def filler_words(pages: list[str]) -> frozenset[str]:
    """Words that keep company with filler phrases: a quarter or more of their pages have such a phrase."""
    total: Counter[str] = Counter()
    beside: Counter[str] = Counter()
    for page in pages:
        words = set(re.findall(r"[^\W\d_]{3,}", page.lower()))
        total.update(words)
        if FILLER.search(page):
            beside.update(words)
    return frozenset(w for w, n in beside.items() if n >= 2 and 4 * n >= total[w])


def _of_filler(line: str, words: frozenset[str]) -> bool:
    found = re.findall(r"[^\W\d_]{3,}", line.lower())
    return len(found) >= 4 and sum(w in words for w in found) >= 0.6 * len(found)


def few_words(lines: list[tuple[str, int]], seed: int = 5) -> list[tuple[str, int]]:
    """A few words each, labelled: of lines of ads, as they are and with a placeholder or filler put among them.

    What is put in are the placeholders and filler phrases that the labelled lines have. So the classifier learns them
    apart from the lines that they happen to stand in.
    """
    rng = random.Random(seed)
    seen = sorted({m[0].strip() for x, y in lines if y == RESIDUE for m in (*PLACEHOLDER.finditer(x), *FILLER.finditer(x)) if 0 < len(m[0].strip()) < 60})
    ads = [w for x, y in lines if y == AD and len(w := x.split()) >= 2 * WORDS]
    out: list[tuple[str, int]] = []
    for words in rng.sample(ads, min(len(ads), FEW)) if seen else []:
        at = rng.randrange(len(words) - WORDS)
        part = words[at : at + WORDS + 1]
        out.append((" ".join(part), AD))
        part[rng.randrange(len(part))] = rng.choice(seen)
        out.append((" ".join(part), RESIDUE))
    return out


def fit_pages(examples: list[tuple[str, str | None, str | None]], **options: object) -> hashed.Model | None:
    """The line classifier of (page, bare text or None, title or None) examples.

    A first fit on pages with a bare text tells which other pages have no line of an ad; of these, the pages with a
    response status or a phrase of a notice lend the second fit their lines as notices.
    """
    pages = [p for p, _, _ in examples]
    strange = filler_words(pages)
    buf, offsets = hashed.text_buffer(pa.array(pages, pa.string()))
    starts, ends, doc = hashed.lines_of(buf, offsets)
    split = [p.split("\n") for p in pages]
    labels = np.array([x for (p, b, t), ls in zip(examples, split, strict=True) for x in (weak_labels(p, b, t) if b else [-1] * len(ls))], dtype=np.int64)
    if not (labels >= 0).any():
        return None
    lines = [x for ls in split for x in ls]
    for k, x in enumerate(lines):
        if (strange and _of_filler(x, strange)) or (labels[k] < 0 and FILLER.search(x)):
            labels[k] = RESIDUE
    every = hashed.units(buf, starts, ends)
    titles = hashed.title_shares(every, doc)
    few = few_words([(x, int(y)) for x, y in zip(lines, labels, strict=True)])
    few_buf, few_at = hashed.text_buffer(pa.array([x for x, _ in few], pa.string()))
    few_labels = np.array([y for _, y in few], dtype=np.int64)
    keep = labels[every.rows] != RESIDUE
    clean = hashed.Units(every.rows[keep], every.first[keep], every.count[keep], every.uni, every.bi, every.extra[keep], every.words[np.repeat(keep, every.count)], every.length[keep])
    known = hashed.known_words(clean, doc)

    def refit(steps: int) -> hashed.Model:
        mine = labels >= 0
        both = hashed.joined(hashed.units(buf, starts[mine], ends[mine], known, titles[mine]), hashed.units(few_buf, few_at[:-1], few_at[1:], known), int(mine.sum()))
        return hashed.fit(both, np.r_[labels[mine], few_labels], 4, known, steps=steps, **options)

    first = refit(15)
    scores = first.scores(hashed.titled(hashed.units(buf, starts, ends, known), doc), len(starts))
    gain = scores[:, AD] - np.maximum(scores[:, PAGE], scores[:, RESIDUE])
    at = 0
    for (_, bare, _), ls in zip(examples, split, strict=True):
        span = range(at, at + len(ls))
        at += len(ls)
        if bare:
            continue
        hits = [k for k in span if STATUS.search(lines[k]) or WALL.search(lines[k])]
        if hits and not any(k not in hits and len(lines[k]) > 45 and gain[k] > 2 for k in span):
            for k in hits:
                labels[k] = NOTICE
            # What stands between and right after the notices, and is not the page's, belongs to them.
            for k in range(hits[0], min(hits[-1] + 3, span.stop)):
                if labels[k] < 0 and lines[k].strip() and gain[k] > -1.5:
                    labels[k] = NOTICE
    return refit(45)


def sample_pages(pages: DataFrame, bare: DataFrame, titles: DataFrame, *, key: str = "job_id", text: str = "description", limit: int = SAMPLE_PAGES) -> DataFrame:
    """(page, bare, title) of at most ``limit`` distinct pages, with the longest bare text and the title of the posting."""
    chosen = cut(distinct_texts(pages.select(key, F.col(text).alias("page")), "page", limit, key))
    # The chosen ids are bounded by ``limit``, so sending them to all executors is, too.
    ids = F.broadcast(chosen.select(key).distinct())
    seen = bare.filter(F.length(text) > 0).join(ids, key, "left_semi").groupBy(key).agg(F.max_by(text, F.struct(F.length(text), F.col(text))).alias("bare"))
    named = titles.join(ids, key, "left_semi").groupBy(key).agg(F.min("title").alias("title"))
    return chosen.join(seen, key, "left").join(named, key, "left").orderBy("mark", "page").select("page", "bare", "title")


def _paths(scores: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each unit whether the most probable path of its document has it in the ad; documents are runs of units."""
    gain = (scores[:, AD] - np.maximum(scores[:, PAGE], scores[:, NOTICE])).tolist()
    out = np.zeros(len(gain), dtype=bool)
    bounds = [*firsts.tolist(), len(gain)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        ad = page = 0.0
        back: list[tuple[bool, bool]] = []
        for k in range(lo, hi):
            to_ad, to_page = page - CHANGE > ad, ad - CHANGE > page
            back.append((to_ad, to_page))
            ad, page = (page - CHANGE if to_ad else ad) + gain[k] / 2, (ad - CHANGE if to_page else page) - gain[k] / 2
        state = ad > page
        for k in range(hi - 1, lo - 1, -1):
            out[k] = state
            to_ad, to_page = back[k - lo]
            state = (not to_ad) if state else to_page
    return out


def judge(texts: pa.Array, model: hashed.Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """Per non-blank line: value, line number, whether in the ad, scores; and per value whether it is residue.

    The classifier decides on residue: a line whose odds for residue are above SURE says so. Where a few words of a
    line have odds for residue above DOUBT, an exact check of its placeholders and filler follows.
    """
    buf, offsets = hashed.text_buffer(texts)
    starts, ends, doc = hashed.lines_of(buf, offsets)
    u = hashed.titled(hashed.units(buf, starts, ends, model.known), doc)
    scores = model.scores(u, len(starts))[u.rows]
    owner = doc[u.rows]
    first_line = np.searchsorted(doc, np.arange(len(offsets) - 1))
    number = u.rows - first_line[owner]
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    in_ad = _paths(scores, firsts)
    length = (ends - starts)[u.rows]

    n = len(offsets) - 1
    best = scores.argmax(axis=1) if len(scores) else np.zeros(0, dtype=np.int64)
    odds = np.full(n, -np.inf)
    np.maximum.at(odds, owner, _residue_odds(scores))
    flags = (odds > SURE).tolist()
    few = model.window_odds(u, RESIDUE, AD, WORDS)
    long_ad = np.bincount(owner, weights=in_ad * (best == AD) * (length > 60), minlength=n) if len(owner) else np.zeros(n)
    notices = np.bincount(owner, weights=best == NOTICE, minlength=n) if len(owner) else np.zeros(n)
    for d in range(n):
        if flags[d]:
            continue
        if long_ad[d] == 0:
            flags[d] = bool(notices[d]) or _notice_in_parts(texts[d].as_py() or "", model)
    for k in np.flatnonzero(few > DOUBT).tolist():
        d = owner[k]
        if not flags[d]:
            # With the line below, into which a placeholder may run.
            to = ends[u.rows[k + 1]] if k + 1 < len(owner) and owner[k + 1] == d else ends[u.rows[k]]
            text = buf[starts[u.rows[k]] : to].tobytes().decode("utf-8", "replace")
            flags[d] = bool(FILLER.search(text)) or unfilled(text)
    return owner, number, in_ad, scores, flags


def _residue_odds(scores: np.ndarray) -> np.ndarray:
    return scores[:, RESIDUE] - np.maximum(scores[:, AD], np.maximum(scores[:, PAGE], scores[:, NOTICE]))


_PARTS = re.compile(r"(?<=[.!?])[ \t]+(?=[^\W\da-zäöü])")


def _notice_in_parts(text: str, model: hashed.Model) -> bool:
    """For a page whose lines run together: whether its sentences hold a notice and none of an ad."""
    if not _PARTS.search(text):
        return False
    buf, offsets = hashed.text_buffer(pa.array([_PARTS.sub("\n", text)]))
    starts, ends, _ = hashed.lines_of(buf, offsets)
    scores = model.score(buf, starts, ends)
    best, length = scores.argmax(axis=1), ends - starts
    sure = scores[:, AD] - np.maximum(scores[:, PAGE], scores[:, NOTICE])
    return bool((best == NOTICE).any() and not ((best == AD) & (length > 30) & (sure > 1)).any())


def residue(pages: DataFrame, model: hashed.Model | None, key: str = "job_id", text: str = "description") -> DataFrame:
    """The keys of the pages that are to be excluded."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema[key]])
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                flags = judge(part.column(1), model)[4]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(flags, pa.bool_()))], names=[name])

    out = pages.filter(F.length(text) > 0).select(key, text)
    return out.select(key).limit(0) if model is None else out.mapInArrow(run, schema)


def body_lines(pages: DataFrame, model: hashed.Model | None, *, of_ad: bool, key: str = "job_id", text: str = "description") -> DataFrame:
    """(key, line_no) of the non-blank lines that are of the ad, or that are not; pages of residue are left out."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema[key], T.StructField("line_no", T.IntegerType())])
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                owner, number, in_ad, _, flags = judge(part.column(1), model)
                keep = (in_ad == of_ad) & ~np.array(flags, dtype=bool)[owner]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[keep])), pa.array(number[keep].astype(np.int32))], names=[name, "line_no"])

    out = pages.filter(F.length(text) > 0).select(key, text)
    return out.select(key, F.lit(0).alias("line_no")).limit(0) if model is None else out.mapInArrow(run, schema)


def bodies(pages: DataFrame, model: hashed.Model | None, *, key: str = "job_id", text: str = "description") -> DataFrame:
    """(key, body): each page rendered, and of its lines only the ad's; pages of residue and empty ones are left out."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema[key], T.StructField("body", T.StringType())])
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                owner, number, in_ad, _, flags = judge(part.column(1), model)
                lines: dict[int, list[int]] = {}
                for o, n in zip(owner[in_ad].tolist(), number[in_ad].tolist(), strict=True):
                    lines.setdefault(o, []).append(n)
                kept = [o for o in lines if not flags[o]]
                out = []
                for o in kept:
                    split = part.column(1)[o].as_py().split("\n")
                    # A blank line between two lines of the ad sets its paragraphs apart.
                    got: list[str] = []
                    for before, n in zip([None, *lines[o]], lines[o], strict=False):
                        if before is not None and n > before + 1 and not split[n - 1].strip():
                            got.append("")
                        got.append(split[n].rstrip())
                    out.append("\n".join(got))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(out, pa.string())], names=[name, "body"])

    shown = pages.filter(F.length(text) > 0).select(key, rendered(F.col(text)).alias(text))
    return shown.select(key, F.lit("").alias("body")).limit(0) if model is None else shown.mapInArrow(run, schema)
