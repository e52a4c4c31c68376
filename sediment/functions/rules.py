"""Rule tables turned into column expressions. A rule is (label, pattern); patterns go through patterns.java()."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions import keywords, patterns, tables


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose pattern is found."""
    text, out = F.coalesce(text, F.lit("")), None
    for label, pattern in rules:
        test = text.rlike(patterns.java(pattern))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def any_match(text: Column, rules: Iterable[tuple[str, str]], lowered: Column | None = None) -> Column:
    """Labels of all rules whose pattern is found, in the rules' order. lowered: the text in lower case, if it is a column already."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.lower(text) if lowered is None else lowered
    return F.filter(F.array(*(F.when(keywords.matches(text, p, lowered), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull())


def of_topics(strong: Column, body: Column, topics: Mapping[str, list[str]], least: int = 2) -> Column:
    """Topics of which the keywords found in the structured text have one, or those found in the free text so many different ones."""

    def test(words: list[str]) -> Column:
        own = F.array(*(F.lit(w.lower()) for w in words))
        return F.arrays_overlap(strong, own) | (F.size(F.array_intersect(body, own)) >= least)

    return F.filter(F.array(*(F.when(test(words), F.lit(topic)) for topic, words in topics.items())), lambda x: x.isNotNull())


def two_tier(strong: Column, body: Column, topics: Mapping[str, list[str]], least: int = 2) -> Column:
    """Topics with a keyword in the structured text, or with so many different keywords in the free text. Each text is gone over once."""
    every = [w for words in topics.values() for w in words]
    both = F.struct(*(keywords.found(F.lower(F.coalesce(x, F.lit(""))), every).alias(n) for n, x in (("strong", strong), ("body", body))))
    return F.get(F.transform(F.array(both), lambda m: of_topics(m["strong"], m["body"], topics, least)), F.lit(0))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The value of a key, whatever its case and outer white space; null if unknown."""
    if not table:
        return F.lit(None).cast("string")
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(pairs, F.lower(F.trim(F.coalesce(key, F.lit("")))))


def member(key: Column, groups: Iterable[tuple[str, Iterable[str]]], default: str) -> Column:
    """The first group that holds a key."""
    out = None
    for label, values in groups:
        test = key.isin(*values)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def names_itself(text: Column, name: str, lowered: Column) -> Column:
    """Whether a text speaks of a unit as its own, not just of it."""
    own = keywords.literals(name)
    test = text.rlike(patterns.java(f"{tables.OWN_BEFORE}(?:{name})")) | text.rlike(patterns.java(f"(?:{name}){tables.OWN_BEHIND}"))
    return F.when(keywords.has_any(lowered, own), test).otherwise(F.lit(False)) if own else test


def unit(strong: Column, overview: Column, department: Column, profession: Column, units: Iterable[tuple[str, str, bool]], departments: Mapping[str, str], professions: Mapping[str, str]) -> tuple[Column, Column]:
    """(unit, its source): a unit of high precedence that names itself, else the department's, the profession's, or any that names itself.

    units: (id, name pattern, high precedence), in order.
    """
    text = F.concat(F.coalesce(strong, F.lit("")), F.lit("\n"), F.coalesce(overview, F.lit("")))
    lowered = F.lower(text)

    def named(high: bool) -> Column:
        rules = [F.when(names_itself(text, name, lowered), F.lit(u)) for u, name, h in units if h is high]
        return F.coalesce(*rules, F.lit(None).cast("string")) if rules else F.lit(None).cast("string")

    found = F.coalesce(named(True), lookup(department, departments), lookup(profession, professions), named(False))
    return found, unit_source(found, department, profession, departments, professions)


def unit_source(found: Column, department: Column, profession: Column, departments: Mapping[str, str], professions: Mapping[str, str]) -> Column:
    """Where unit() has a unit from. found: the unit, which is best a column already, as it is used several times."""
    return F.when(found.isNull(), None).when(found == lookup(department, departments), "department").when(found == lookup(profession, professions), "profession").otherwise("self")
