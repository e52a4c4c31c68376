"""Many keywords or patterns in one text: keywords by one pass over the text's word sequences, patterns only where a part of them occurs.

A keyword is found if no letter or digit stands on either side. A text is cut once into its runs of letters and digits and what lies between; every sequence of up to as many
runs as the longest keyword has is looked up in a hash table of all keywords, so that the work doesn't grow with their number.
A pattern is tried only on texts that contain a literal without which it can't match.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from re import _constants as sre  # the parsed form of a pattern
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions import patterns

_RUN = "[a-z0-9]+"
#: Literals shorter than this don't tell texts apart.
SHORTEST_LITERAL = 2


def is_sequence(keyword: str) -> bool:
    """Whether a keyword begins and ends with a letter or digit; others need their pattern."""
    return re.fullmatch(r"[a-z0-9](?s:.*[a-z0-9])?", keyword) is not None


def _sequences(text: Column, longest: int) -> Column:
    """All different sequences of 1 to longest runs, with what lies between them."""

    def of(p: Column) -> Column:
        n = F.size(p["runs"])

        def at(i: Column, k: int) -> Column:
            parts = [F.get(p["runs"], i)]
            for j in range(1, k):
                parts += [F.get(p["gaps"], i + j), F.get(p["runs"], i + j)]
            return F.concat(*parts)

        def of_size(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: at(i, k))).otherwise(F.array().cast("array<string>"))

        return F.concat(p["runs"], *(of_size(k) for k in range(2, longest + 1)))

    cut = F.struct(F.regexp_extract_all(text, F.lit(_RUN), 0).alias("runs"), F.split(text, _RUN, -1).alias("gaps"))
    return F.get(F.transform(F.array(cut), of), F.lit(0))


def found(lowered: Column, keywords: Iterable[str]) -> Column:
    """array<string>: which of the keywords, in lower case, a lower-case text has."""
    keywords = sorted({k.lower() for k in keywords})
    plain = [k for k in keywords if is_sequence(k)]
    rest = [F.when(lowered.rlike(patterns.keyword(k)), F.lit(k)) for k in keywords if not is_sequence(k)]
    out = F.array().cast("array<string>")
    if plain:
        longest = max(len(re.findall(_RUN, k)) for k in plain)
        out = F.array_intersect(_sequences(lowered, longest), F.array(*map(F.lit, plain)))
    return F.concat(out, F.filter(F.array(*rest), lambda x: x.isNotNull())) if rest else out


def _literals(items) -> frozenset[str] | None:
    """Literals of which a match must contain one, in lower case; None if there are none. The choice whose shortest literal is longest."""
    choices, run = [], ""

    def close() -> None:
        nonlocal run
        if len(run) >= SHORTEST_LITERAL:
            choices.append(frozenset([run]))
        run = ""

    for kind, value in items:
        if kind is sre.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is sre.AT:  # an edge takes no character
            continue
        close()
        if kind is sre.SUBPATTERN:
            choices.append(_literals(value[3]))
        elif kind is sre.BRANCH:
            each = [_literals(b) for b in value[1]]
            choices.append(None if None in each else frozenset().union(*each))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            choices.append(_literals(value[2]))
    close()
    known = [x for x in choices if x]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@functools.cache
def literals(pattern: str) -> tuple[str, ...]:
    """What a match of a case-insensitive pattern contains one of; none if that can't be told."""
    return tuple(sorted(_literals(_parser.parse(pattern.replace(r"\z", r"\Z"))) or ()))


def has_any(lowered: Column, own: Iterable[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (lowered.contains(x) for x in own))


def matches(text: Column, pattern: str, lowered: Column) -> Column:
    """Whether a pattern of the rule tables is found in a text, of which lowered is the lower case."""
    own = literals(pattern)
    test = text.rlike(patterns.java(pattern))
    if not own:
        return test
    return F.when(has_any(lowered, own), test).otherwise(F.lit(False))
