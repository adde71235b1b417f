"""Linear classification of text units on hashed n-grams, vectorised over Arrow buffers.

Units (lines, tails of texts) are spans of one byte buffer. Tokens are runs of letters and digits, or of other marks;
letters lower, digits all alike. Each token gives a unigram and a bigram with what follows; each unit its first token,
its whole text and classes of its length and of its share of unknown words; and by the title of its document, which is
the document's first unit: whether it is the title, and which share of its words the title has. All are hashed into one weight table, so
the model has one size whatever the corpus; scoring is a handful of array operations per megabyte and no Python per
unit. Fitting is softmax regression with L2 regularisation by full-batch gradient steps, in numpy, on the labelled
units that it is given.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

BITS = 17
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_K1, _K2, _K3, _K4, _K5 = (_U(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_START, _END = _U(0x51ED270B), _U(0x2545F491)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 16)
        up, down = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _K1
    return h ^ (h >> _U(29))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and the n + 1 offsets of its values in them; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line of each value (separated by newlines), and the value it is in."""
    breaks = np.flatnonzero(buf == 10)
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    owner_s = np.concatenate([np.arange(n), doc])
    owner_e = np.concatenate([doc, np.arange(n)])
    starts = starts[np.lexsort((starts, owner_s))]
    order = np.lexsort((ends, owner_e))
    return starts, ends[order], np.sort(owner_s, kind="stable")


@dataclass
class Units:
    """Features of units: per token two table positions, per unit some more."""

    rows: np.ndarray  # units that have a token
    first: np.ndarray  # index of each such unit's first token
    count: np.ndarray  # its number of tokens
    uni: np.ndarray
    bi: np.ndarray
    extra: np.ndarray  # (units, k) table positions
    words: np.ndarray  # token hashes, before mixing
    length: np.ndarray  # class of each such unit's length


def units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray | None = None, title: np.ndarray | None = None) -> Units:
    """Features of the spans ``starts:ends``, which are in order and do not overlap.

    ``title`` is from :func:`title_shares`; without it, the features by the title are those of an unknown title.
    """
    n = len(buf)
    up, down = _power_tables(n)
    low = _LOWER[buf]
    if n > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][capital] += 32
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + _U(1)) * up[:n], out=prefix[1:])
    kind = _CLASS[buf]
    inside = np.zeros(n + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    kind = np.where(np.cumsum(inside[:n], dtype=np.int8) > 0, kind, 0) if n else kind
    edge = np.ones(n + 1, dtype=bool)
    if n:
        edge[1:n] = kind[1:] != kind[:-1]
        edge[starts[starts < n]] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    keep = kind[s] > 0 if n else np.zeros(0, dtype=bool)
    s, e = s[keep], e[keep]
    words = (prefix[e] - prefix[s]) * down[s]
    unit = np.searchsorted(starts, s, side="right") - 1
    rows, first, count = np.unique(unit, return_index=True, return_counts=True)
    follow = np.empty(len(words), dtype=np.uint64)
    if len(words):
        follow[:-1] = words[1:]
        follow[first + count - 1] = _END
    shift = _U(64 - BITS)
    us, ue = starts[rows], ends[rows]
    whole = (prefix[ue] - prefix[us]) * down[us]
    head = words[first] if len(first) else words[:0]
    length = np.minimum(np.log2(ue - us + 1).astype(np.int64), 12).astype(np.uint64)
    long_word = (e - s >= 4) & (kind[s] == 1) if n else np.zeros(0, dtype=bool)
    if known is not None and len(first):
        unknown = long_word & ~known[(_mix(words ^ _K5) >> _U(44)).astype(np.int64)]
        total = np.add.reduceat(long_word.astype(np.int32), first)
        share = np.add.reduceat(unknown.astype(np.int32), first) * 5 // np.maximum(total, 1)
        strange = np.where(total >= 3, share, 9).astype(np.uint64)
    else:
        strange = np.full(len(rows), 10, dtype=np.uint64)
    by_title = (title[rows] if title is not None else np.full(len(rows), 15)).astype(np.uint64)
    extra = np.stack([*_by_title(by_title, length), _mix(head * _K3 + _START), _mix(whole * _K4 + _START), _mix((length + _U(1)) * _K5), _mix((strange + _U(99)) * _K3), _mix((strange + _U(99)) * _K3 + length * _K4)], axis=1) >> shift
    return Units(rows, first, count, (_mix(words * _K2) >> shift).astype(np.int32), (_mix(words * _K1 + follow * _K4) >> shift).astype(np.int32), extra.astype(np.int32), words, length)


def joined(a: Units, b: Units, n: int) -> Units:
    """The units of ``a``, of which there are ``n`` with and without tokens, and after them those of ``b``."""
    cat = lambda f: np.concatenate([getattr(a, f), getattr(b, f)])
    return Units(np.r_[a.rows, b.rows + n], np.r_[a.first, b.first + len(a.uni)], cat("count"), cat("uni"), cat("bi"), cat("extra"), cat("words"), cat("length"))


def _by_title(title: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _mix((title + _U(7)) * _K2 + _START), _mix((title + _U(7)) * _K2 + length * _K1)


def titled(u: Units, doc: np.ndarray) -> Units:
    """The units with their features by the title."""
    extra = u.extra.copy()
    for k, x in enumerate(_by_title(title_shares(u, doc)[u.rows].astype(np.uint64), u.length)):
        extra[:, k] = x >> _U(64 - BITS)
    return replace(u, extra=extra)


def title_shares(u: Units, doc: np.ndarray) -> np.ndarray:
    """A class for each unit by its document's title: 14 for the title itself, else the share of its tokens in it, in fifths."""
    out = np.full(len(doc), 15, dtype=np.int64)
    if not len(u.rows):
        return out
    owner = doc[u.rows]
    title = np.r_[True, owner[1:] != owner[:-1]]
    per_token = np.repeat(title, u.count)
    keys = _mix(u.words * _K2) ^ (np.repeat(owner, u.count).astype(np.uint64) * _K4)
    # Each title's tokens are marked in a map of bits; it has 64 or more for each, so that few are met by chance.
    size = 1 << max(16, int(per_token.sum() * 64).bit_length())
    marked = np.zeros(size, dtype=bool)
    spot = (keys & _U(size - 1)).astype(np.int64)
    marked[spot[per_token]] = True
    inside = marked[spot]
    share = np.add.reduceat(inside.astype(np.int32), u.first) * 5 // u.count
    out[u.rows] = np.where(title, 14, share)
    return out


def known_words(units_: Units, doc: np.ndarray, least: int = 2) -> np.ndarray:
    """Bitmap of word hashes that occur in ``least`` documents or more; ``doc`` is each unit's document."""
    spot = (_mix(units_.words ^ _K5) >> _U(44)).astype(np.int64)
    of = np.repeat(doc[units_.rows], units_.count)
    pairs = np.unique(np.stack([spot, of.astype(np.int64)], axis=1), axis=0)
    return np.bincount(pairs[:, 0], minlength=1 << 20) >= least


@dataclass
class Model:
    """Weights (table, classes), bias, and the known words."""

    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray | None

    def scores(self, u: Units, n: int) -> np.ndarray:
        """Log-odds-like scores (units, classes); units without a token have the bias alone."""
        out = np.repeat(self.bias[None, :], n, axis=0).astype(np.float32)
        if len(u.rows):
            sums = np.add.reduceat(self.weights[u.uni] + self.weights[u.bi], u.first, axis=0)
            for k in range(u.extra.shape[1]):
                sums += self.weights[u.extra[:, k]] * 0.5 * np.sqrt(2 * u.count + 1)[:, None]
            out[u.rows] += sums / np.sqrt(2 * u.count + 1)[:, None]
        return out

    def window_odds(self, u: Units, one: int, other: int, size: int) -> np.ndarray:
        """The greatest log-odds of class ``one`` against ``other`` of any ``size`` tokens in a row, for each of ``u.rows``."""
        if not len(u.rows):
            return np.zeros(0, dtype=np.float32)
        gap = np.ascontiguousarray(self.weights[:, one] - self.weights[:, other])
        sums = np.concatenate([[0.0], np.cumsum(gap[u.uni] + gap[u.bi], dtype=np.float64)])
        at = np.arange(len(u.uni))
        last = np.repeat(u.first + u.count, u.count)
        to = np.minimum(at + size, last)
        odds = (sums[to] - sums[at]) / np.sqrt(2 * (to - at) + 1)
        return np.maximum.reduceat(odds, u.first) + self.bias[one] - self.bias[other]

    def score(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.scores(units(buf, starts, ends, self.known), len(starts))


def fit(u: Units, labels: np.ndarray, n_classes: int, known: np.ndarray | None, *, l2: float = 1e-5, steps: int = 60, rate: float = 2.0, balance: bool = True) -> Model:
    """Softmax regression of the units' labels (per unit of ``u.rows``); classes weigh alike if ``balance``."""
    y = labels[u.rows]
    size = 1 << BITS
    scale = (1 / np.sqrt(2 * u.count + 1)).astype(np.float32)
    of = np.repeat(np.arange(len(u.rows), dtype=np.int32), u.count)
    counts = np.bincount(y, minlength=n_classes)
    weight = (len(y) / (n_classes * np.maximum(counts, 1)))[y] ** 0.5 if balance else np.ones(len(y))
    weight = (weight / weight.sum()).astype(np.float32)
    # One class at a time: what is held at once is a few numbers per token.
    w, g2 = np.zeros((n_classes, size), dtype=np.float32), np.full((n_classes, size), 1e-12, dtype=np.float32)
    b = np.zeros(n_classes, dtype=np.float32)
    z = np.empty((len(y), n_classes), dtype=np.float32)
    for _ in range(steps):
        for c in range(n_classes):
            z[:, c] = np.add.reduceat(w[c][u.uni] + w[c][u.bi], u.first) * scale + b[c]
            for k in range(u.extra.shape[1]):
                z[:, c] += 0.5 * w[c][u.extra[:, k]]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z *= weight[:, None]
        for c in range(n_classes):
            e = (z[:, c] * scale)[of]
            g = np.bincount(u.uni, weights=e, minlength=size) + np.bincount(u.bi, weights=e, minlength=size)
            for k in range(u.extra.shape[1]):
                g += np.bincount(u.extra[:, k], weights=0.5 * z[:, c], minlength=size)
            g = g.astype(np.float32) + l2 * w[c]
            g2[c] += g * g
            w[c] -= rate * 0.25 * g / np.sqrt(g2[c])
        b -= 2 * z.sum(axis=0)
    return Model(np.ascontiguousarray(w.T), b, known)
