"""JSON texts of any depth.

The standard parser recurses, so it gives up on deep nesting; :func:`load` then reads the text as a series of events
with a stack of its own. Both ways accept and reject the same texts and give the same values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)")
_WORDS = {"true": True, "false": False, "null": None}
_END = object()


def _reject(text: str) -> None:
    raise ValueError(text)


def _by_events(text: str, number: Callable[[str], object]) -> object:
    root: object = _END
    stack: list[list | dict] = []
    names: list[str | None] = []
    at, n = _BLANK.match(text).end(), len(text)
    while True:
        # A value stands at ``at``.
        c = text[at : at + 1]
        value: object
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in ("{", "["):
            value = {} if c == "{" else []
            at += 1
        elif m := _SCALAR.match(text, at):
            value, at = (number(m[0]) if m["number"] else _WORDS[m[0]]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        if not stack:
            root = value
        elif isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)
        fresh = c in ("{", "[")
        if fresh:
            stack.append(value)
            names.append(None)
        # Closing marks, until a further value is due.
        while stack:
            at = _BLANK.match(text, at).end()
            top = stack[-1]
            c = text[at : at + 1]
            if c == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
                names.pop()
                at, fresh = at + 1, False
                continue
            if not fresh:
                if c != ",":
                    raise ValueError(f"no comma at {at}")
                at = _BLANK.match(text, at + 1).end()
            if isinstance(top, dict):
                if text[at : at + 1] != '"':
                    raise ValueError(f"no name at {at}")
                names[-1], at = scanstring(text, at + 1, True)
                at = _BLANK.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _BLANK.match(text, at + 1).end()
            break
        if not stack:
            if _BLANK.match(text, at).end() != n:
                raise ValueError(f"more text at {at}")
            return root


def load(text: str, number: Callable[[str], object] = float) -> object:
    """The value of a JSON text, numbers by ``number`` of their spelling; a ValueError if it is none."""
    try:
        return json.loads(text, parse_int=number, parse_float=number, parse_constant=_reject)
    except RecursionError:
        return _by_events(text, number)
