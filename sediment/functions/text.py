"""Text functions as column expressions: HTML, sections, passages, tokens, years, places."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions import keywords, tables
from sediment.functions.patterns import java


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, java(r"^\s+"), ""), java(r"\s+$"), "")


def _squeeze(text: Column) -> Column:
    # a single space is left where it is, as most are
    return _trim(F.regexp_replace(F.regexp_replace(text, r" [ \t]+|\t[ \t]*", " "), r"\n{3,}", "\n\n"))


def plain_text(html: Column) -> Column:
    """Line ends for breaks and closed paragraphs, spaces for other tags, entities decoded (unknown ones are spaces), white space squeezed. Null stays null."""

    def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
        for pattern, by in rules:
            text = F.regexp_replace(text, pattern, by)
        return text

    # entities are looked for only where their mark is
    tags, entities = ([r for r in tables.MARKUP if ("&" in r[0]) is marked] for marked in (False, True))
    bare = F.transform(F.array(replaced(html, tags)), lambda t: F.when(t.contains("&"), replaced(t, entities)).otherwise(t))
    return _squeeze(F.get(bare, F.lit(0)))


def without(text: Column, removals: list[str]) -> Column:
    """Each pattern's matches replaced by a space, in order, then white space squeezed. A pattern is tried where the words of a literal of it occur.

    A removal leaves a space, so it makes no new word: the words are looked for once, in the text as it was. The patterns that are left are gone through
    by one fold, as Spark's time for steps inside each other doubles with each."""

    def due(lowered: Column) -> Column:
        def test(pattern: str) -> Column:
            own = [functools.reduce(lambda a, b: a & b, (lowered.contains(w) for w in x.split())) for x in keywords.literals(pattern)]
            return functools.reduce(lambda a, b: a | b, own) if own else F.lit(True)

        return F.filter(F.array(*(F.when(test(p), F.lit(i)) for i, p in enumerate(removals))), lambda i: i.isNotNull())

    def cut(t: Column, i: Column) -> Column:
        out = F
        for k, p in enumerate(removals):
            # what begins with the rest of a line begins at the line's start, and isn't tried at each of its characters
            out = out.when(i == k, F.regexp_replace(t, re.sub(r"^(\(\?\w+\))(\[\^\\n\]\*)", r"\1(?<![^\\n])\2", p), " "))
        return out.otherwise(t)

    def of(t: Column) -> Column:
        return F.aggregate(F.get(F.transform(F.array(F.lower(t)), due), F.lit(0)), t, cut)

    return _squeeze(F.get(F.transform(F.array(text), of), F.lit(0)) if removals else text)


def fingerprint(text: Column) -> Column:
    """16 hexadecimal digits of SHA-1; null is the empty text."""
    return F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)


def _section(text: Column, heading: str, ends: str, fallback: Column, size: int) -> Column:
    # the rest of the text, cut at its first end, rather than all beginnings of the rest up to one
    body = F.regexp_replace(F.regexp_extract(text, java(rf"{heading}\s*\n+(?s:(.*))"), 1), java(rf"\n\s*(?:{ends})\b(?s:.*)"), "")
    found = text.rlike(java(rf"{heading}\s*\n"))
    return F.substring(F.when(found, body).otherwise(fallback), 1, size)


def overview(text: Column) -> Column:
    """The overview section; without one the beginning of the text."""
    return _section(text, "Overview", tables.OVERVIEW_ENDS, F.substring(text, 1, 2500), 4000)


def short_overview(text: Column) -> Column:
    """40 to 900 characters of the overview, or the first 600, on one line of 700 at most."""
    own = F.regexp_extract(text, java(rf"Overview\s*\n+(?s:(.{{40,900}}?))(?:\n\s*(?:{tables.SHORT_OVERVIEW_ENDS})\b|$)"), 1)
    short = F.get(F.transform(F.array(own), lambda o: F.when(o != "", o).otherwise(F.substring(text, 1, 600))), F.lit(0))
    return F.substring(_trim(F.regexp_replace(short, java(r"\s+"), " ")), 1, 700)


def qualifications(text: Column) -> Column:
    """The qualifications section; empty without one."""
    return _section(text, tables.QUALIFICATIONS, tables.QUALIFICATIONS_ENDS, F.lit(""), 6000)


_MARK = "\u0001"


def sections(text: Column, keep: tuple[str, ...] = ("overview", "responsibilities")) -> Column:
    """array<struct<section, text>>: the sections of these headings. A heading stands alone on its line, and each section ends at the next one, so an empty one takes nothing of its neighbour."""
    heading = rf"(?im)^[ \t]*({tables.HEADINGS})[ \t]*:?[ \t]*\r?$"

    def of(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("section"), F.get(parts, i + 1).alias("text")))
        return F.filter(pairs, lambda x: F.lower(x["section"]).isin(*keep) & x["text"].isNotNull())

    return F.get(F.transform(F.array(F.split(F.regexp_replace(text, heading, f"{_MARK}$1{_MARK}"), _MARK)), of), F.lit(0))


def excerpt(text: Column) -> Column:
    """A cut text up to its last finished sentence, as one section; none if no sentence ends."""
    own = F.regexp_extract(text, java(r"^[\s\S]*[.!?](?:\s|$)"), 0)
    return F.when(own != "", F.array(F.struct(F.lit("excerpt").alias("section"), own.alias("text")))).otherwise(F.array().cast("array<struct<section:string,text:string>>"))


def passages(parts: Column, least: int = 25) -> Column:
    """array<struct<section, text>>: sentences and lines of sections, on one line each, of so many characters or more."""

    def split(p: Column) -> Column:
        lines = F.transform(F.split(p["text"], r"\n+|(?<=[.!?])[\s ﻿]+"), lambda x: _trim(F.regexp_replace(x, java(r"\s+"), " ")))
        return F.transform(F.filter(lines, lambda x: F.length(x) >= least), lambda x: F.struct(p["section"].alias("section"), x.alias("text")))

    return F.flatten(F.transform(parts, split))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9_]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens in their order, with the marks that names of techniques have."""
    raw = F.regexp_replace(F.lower(text), "[^a-z0-9+#&./ -]+", " ")
    bare = F.regexp_replace(raw, r"(?=[-.])(?:(?<![^ ])[-.]+|[-.]+(?![^ ]))", "")  # marks at a word's edges
    return F.filter(F.split(bare, " +"), lambda w: w != "")


def is_content(word: Column) -> Column:
    return (F.length(word) >= 3) & ~word.isin(*tables.COMMON_WORDS) & ~word.rlike(r"^[0-9]+$")


def terms(text: Column) -> Column:
    """Different content words, and pairs of content words that stand next to each other."""

    def of(marks: Column) -> Column:
        n = F.greatest(F.size(marks) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(marks, 1, n), F.slice(marks, 2, n), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.array_distinct(F.concat(F.filter(marks, lambda x: x.isNotNull()), F.filter(pairs, lambda x: x.isNotNull())))

    return F.get(F.transform(F.array(F.transform(tokens(text), lambda w: F.when(is_content(w), w))), of), F.lit(0))


def title_words(title: Column) -> Column:
    """Different words of a title, without short and common ones."""
    words = F.transform(F.split(F.lower(title), r"[^a-z0-9+#.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*tables.TITLE_WORDS)))


def required_years(text: Column) -> Column:
    """The least number of years from 1 to 20 that a text asks for; null if none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tables.YEARS + r"(?![A-Za-z0-9_])"), 1), lambda x: x.cast("int"))
    return F.array_min(F.filter(found, lambda n: n.between(1, 20)))


def place(location: Column, standardised: Column) -> Column:
    """struct<city, country, code>. "Country, Region, City"; two parts are "City, Country". The code is the last part of the standardised place."""

    def parts(x: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda w: F.trim(w)), lambda p: p != "")

    def of(p: Column) -> Column:
        n = F.size(p)
        country = F.when(n == 0, "Unknown").when(n == 2, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0)))
        for short, long in tables.COUNTRIES.items():
            country = F.when(country == short, long).otherwise(country)
        city = F.when(n == 0, "Unknown").when(n >= 3, F.get(p, n - 1)).otherwise(F.get(p, F.lit(0)))
        codes = parts(standardised)
        return F.struct(city.alias("city"), country.alias("country"), F.when(n > 0, F.get(codes, F.size(codes) - 1)).alias("code"))

    return F.get(F.transform(F.array(parts(location)), of), F.lit(0))


def city_label(city: Column, country: Column) -> Column:
    several = F.coalesce(F.lower(city), F.lit("")).isin("", "multiple locations")
    return F.when(several, F.concat(country, F.lit(" — multiple sites"))).otherwise(F.concat_ws(", ", city, country))


def short_label(label: Column) -> Column:
    """Without the first acronym in brackets."""
    return F.regexp_replace(label, r"^(.*?)\s*\([A-Z&+]{2,6}\)", "$1")


def short_unit(label: Column) -> Column:
    """Without any acronym in brackets at the end."""
    return F.regexp_replace(label, r"\s*\([^)]*\)\s*\z", "")
