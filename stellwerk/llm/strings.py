"""String helpers shared by the operators on typed names: folding, repair of wrong decodings, edit distance."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060\ufeff]")
_BLANK = re.compile(r"\s+")
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe"})
_WRONG = re.compile("[\u00c2\u00c3][\u0080-\u00bf\u0152-\u2122]")
_BYTE_OF = {bytes([b]).decode("cp1252", "ignore"): b for b in range(128, 256)} | {chr(b): b for b in range(256)}


def repair(text: str) -> str:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, read rightly; other text as it is."""
    if not _WRONG.search(text):
        return text
    try:
        return bytes(_BYTE_OF[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return text


def tidy(text: str) -> str:
    """Repaired, composed, without invisible characters, blanks collapsed."""
    return _BLANK.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", repair(text)))).strip()


def spell_out(text: str) -> str:
    """Lower case with umlauts spelt out, other marks dropped."""
    low = text.lower().translate(_UMLAUTS)
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def strip_marks(text: str) -> str:
    """Lower case with all marks dropped, ß as ss."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea -= 1
        eb -= 1
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == 1 and len(b) == 1 or len(a) == 2 and len(b) == 2 and a[0] == b[1] and a[1] == b[0]:
        return 1
    if most <= 1:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class Near:
    """Words, found by any spelling that is an edit or two away: by a shared rest after leaving letters out."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.longest = max(map(len, self.words), default=0)
        self._rests: tuple[dict[str, list[str]], ...] = ({}, {}, {})
        for k in (1, 2):
            for w in sorted(self.words):
                for r in _rests(w, k):
                    self._rests[k].setdefault(r, []).append(w)

    def of(self, word: str, most: int) -> list[tuple[int, str]]:
        """(edits, entry) of the entries within ``most`` edits, which is 1 or 2."""
        if len(word) > self.longest + most:
            return []
        index = self._rests[most]
        near = {w for r in _rests(word, most) for w in index.get(r, ())}
        return sorted((d, w) for w in near if (d := distance(word, w, most)) <= most)

    def has(self, word: str, least: int = 0, among: int = 0) -> bool:
        """Whether ``word`` is an entry or, with ``least`` letters or more, an edit away from one of ``among`` or more."""
        return word in self.words or (len(word) >= least and any(len(w) >= among for _, w in self.of(word, 1)))


def _rests(word: str, most: int) -> set[str]:
    """The word with up to so many letters left out."""
    one = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    return one if most == 1 else one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}
