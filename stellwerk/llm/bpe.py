"""Byte-pair encoding of a whole corpus with a public tokenizer, as a streaming transducer.

A text is cut into pieces by the tokenizer's pattern, and each piece is encoded by :class:`Transducer`, from left to
right, byte by byte. The state after a prefix is the last token of that prefix's encoding; it is the one vocabulary
entry ending there that may follow the state it attaches to, where "may follow" is decided by the merge list alone
(the two tokens' bytes, merged by rank, give just these two tokens). What comes later can only attach to one of the
last ``lookahead`` states, ``lookahead`` being the length of the longest token; tokens on which all of these agree are
stable and are emitted at once. So memory stays constant for pieces of any length. :class:`Decoder` is the inverse:
tokens to text, holding back an incomplete multi-byte character.

Defined results: a null and an empty text both have the empty list; text that looks like a special token is ordinary
text; lone surrogates cannot occur in a string column. The vocabulary's path is a parameter. Repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import functools
import importlib.util
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How texts are cut into pieces by the vocabulary's publisher (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a process remembers; beyond it the memory is emptied, results stay the same.
REMEMBERED = 1 << 18


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


class Vocabulary:
    """Tokens by rank, and what the merge list says about their neighbourhood."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with Path(path).open("rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """The encoding of a short piece by its definition: merge the neighbours of lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand right after ``a``."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def stands(self, a: int) -> bool:
        """Whether token ``a`` is the encoding of its own bytes."""
        known = self._whole.get(a)
        if known is None:
            known = self._whole[a] = self.merge(self.tokens[a]) == [a]
        return known


class Transducer:
    """Encodes one piece fed in parts; ``feed`` returns the tokens that have become stable."""

    def __init__(self, vocabulary: Vocabulary, *, check_every: int = 64) -> None:
        self.v = vocabulary
        self.lookahead = vocabulary.longest
        self.check_every = check_every
        self.window = b""
        # states[i]: (token, length) that ends after i bytes of the window; states[0] is the start.
        self.states: list[tuple[int, int]] = [(-1, 0)]
        self.first = True
        self.before = -1

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        v, ranks = self.v, self.v.ranks
        for k in range(0, len(data), self.check_every):
            self.window += data[k : k + self.check_every]
            window, states = self.window, self.states
            for end in range(len(states), len(window) + 1):
                for size in range(min(end, v.longest), 0, -1):
                    token = ranks.get(window[end - size : end])
                    if token is None:
                        continue
                    prior = states[end - size][0] if size < end else self.before
                    if v.stands(token) if prior < 0 else v.follows(prior, token):
                        states.append((token, size))
                        break
            if len(window) > 2 * self.lookahead:
                out += self._stable()
        return out

    def _path(self, end: int) -> list[int]:
        """Ends of the tokens of the encoding of the first ``end`` bytes of the window."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= self.states[end][1]
        return ends[::-1]

    def _stable(self) -> list[int]:
        live = range(max(1, len(self.window) - self.lookahead + 1), len(self.window) + 1)
        common: set[int] | None = None
        for e in live:
            ends = set(self._path(e))
            common = ends if common is None else common & ends
        path = self._path(len(self.window))
        agreed = [e for e in path if e in (common or ())]
        # Only a prefix of tokens that all live states share is stable.
        stable = [e for e, p in zip(agreed, path, strict=False) if e == p]
        if not stable:
            return []
        cut = stable[-1]
        out = [self.states[e][0] for e in stable]
        self.window = self.window[cut:]
        self.states = [(-1, 0)] + self.states[cut + 1 :]
        self.before = out[-1]
        return out

    def finish(self) -> list[int]:
        out = [self.states[e][0] for e in self._path(len(self.window))]
        self.window, self.states, self.before = b"", [(-1, 0)], -1
        return out


class Decoder:
    """Tokens to text, an incomplete character being held back until its bytes are there."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, tokens: Iterable[int]) -> str:
        return "".join(self._decoder.decode(self.v.tokens[t]) for t in tokens)

    def finish(self) -> str:
        return self._decoder.decode(b"", final=True)


class Encoder:
    """Texts to ids; pieces seen before are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.v = vocabulary
        self.pieces = regex.compile(pattern)
        self.memory: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """How many ids a text has, without making them."""
        n, sizes = 0, self.sizes
        for piece in self.pieces.findall(text) if text and len(text) < 1 << 20 else (m[0] for m in self.pieces.finditer(text or "")):
            k = sizes.get(piece)
            if k is None:
                k = len(self.piece(piece))
                if len(piece) < 64:
                    if len(sizes) >= REMEMBERED:
                        sizes.clear()
                    sizes[piece] = k
            n += k
        return n

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ranks.get(data)
        if whole is not None and self.v.stands(whole):
            return [whole]
        transducer = Transducer(self.v)
        return transducer.feed(data) + transducer.finish()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memory = self.memory
        for piece in self.pieces.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.pieces.finditer(text)):
            ids = memory.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) < 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per process."""
    return Encoder(Vocabulary.load(path))


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row."""
    where = path or vocabulary_path()
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = pa.array([e.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[name, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; 0 for null and empty."""
    where = path or vocabulary_path()

    @F.arrow_udf("bigint")
    def count(t: pa.Array) -> pa.Array:
        e = encoder(where)
        # Texts that a batch has more than once are counted once.
        once = t.dictionary_encode()
        sizes = pa.array([e.count(x.as_py()) for x in once.dictionary], pa.int64())
        return sizes.take(once.indices).fill_null(0)

    return count(text)
