"""Patterns that mean the same in Java's regex engine as in browsers' one."""

from __future__ import annotations

import functools
import re
from re import _constants as sre  # the parsed form of a pattern
from re import _parser

#: A word's edge by ASCII letters, digits and underscore; Java's own goes by Unicode.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SPACE = "[\\s ﻿]"


def _starts(items) -> tuple[frozenset[str] | None, bool]:
    """Characters that a match can begin with (None if they can't be told), and whether it can be empty."""
    out: frozenset[str] = frozenset()
    for kind, value in items:
        if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # they take no character
            continue
        own, empty = None, False
        if kind is sre.LITERAL and value < 128:
            own = frozenset(chr(value))
        elif kind is sre.IN and all(k is sre.LITERAL and v < 128 or k is sre.RANGE and v[1] < 128 for k, v in value):
            own = frozenset(chr(x) for k, v in value for x in (range(v[0], v[1] + 1) if k is sre.RANGE else (v,)))
        elif kind is sre.SUBPATTERN:
            own, empty = _starts(value[3])
        elif kind is sre.BRANCH:
            each = [_starts(b) for b in value[1]]
            own, empty = None if any(x is None for x, _ in each) else frozenset().union(*(x for x, _ in each)), any(e for _, e in each)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            own, empty = _starts(value[2])
            empty = empty or value[0] == 0
        if own is None:
            return None, True
        out |= own
        if not empty:
            return out, False
    return out, True


@functools.cache
def starting(pattern: str) -> str:
    """A look-ahead for the characters of either case that a match can begin with: an engine passes over other places by it, and it changes no match. Empty if they can't be told."""
    try:
        own, empty = _starts(_parser.parse(pattern.replace(r"\z", r"\Z")))
    except re.error:
        return ""
    if empty or not own:
        return ""
    both = sorted({x for c in own for x in (c.lower(), c.upper())})
    return "(?=[" + "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in both) + "])"


def java(pattern: str, ignore_case: bool = True) -> str:
    """ASCII word edges, wider white space, an end that isn't before a last line end, and no nested classes."""
    first = starting(pattern)
    return ("(?i)" if ignore_case else "") + (f"{first}(?:{_java(pattern)})" if first else _java(pattern))


def _java(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(EDGE)
            i += 2
        elif two == r"\s":
            out.append(SPACE[1:-1] if in_class else SPACE)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        elif in_class and pattern[i] == "[":
            out.append(r"\[")
            i += 1
        elif pattern[i] == "$" and not in_class:
            out.append(r"\z")
            i += 1
        else:
            in_class = in_class and pattern[i] != "]" or not in_class and pattern[i] == "["
            out.append(pattern[i])
            i += 1
    return "".join(out)


def keyword(word: str) -> str:
    """A keyword in lower-case text with no letter or digit on either side. Understood by RE2 too."""
    return "(^|[^a-z0-9])" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", word.lower()) + r"([^a-z0-9]|\z)"


def any_keyword(words: list[str]) -> str:
    return "|".join(keyword(w) for w in words)
