"""Quality rules by distribution divergence, as one projection: no shuffle, no Python.

Each text's character-class histogram and its histogram of common words are compared with references
of four languages by the Jensen-Shannon distance (base 2, 0 to 1). A text is kept if its characters
are near the reference of one language and its common words near one; a histogram that rests on fewer
characters or words than its guard isn't judged. Before that come the plain rules: too few
words, or more than half of the words in repeated three-word windows.

Identifiers (keys, hashes, card numbers, addresses that hold digits) say nothing of the prose around them, yet one of them outweighs the digits
of a whole short text. So character classes are counted without them, unless they are more than half of the text.

A null text is the empty one: no words, base_failed, not kept. Repeated rows give repeated results;
an empty table gives none. Only doc_id and text are read, so other columns cannot clash. A very long text
is held whole by one task, with an array of its words and one of its windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.native import indices, let, words

MIN_WORDS = 50
#: Histograms are judged from these lengths on.
GUARD_CHARS, GUARD_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.16, 0.37

#: What is left of a word from its first digit on, if that is long: identifiers, not prose.
IDENTIFIER = r"[0-9][^\s]{11,}"

#: Shares of lower-case letters, capitals, digits, white space, punctuation and the rest in ordinary prose.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\s", "punct": r"[.,;:!?'\"()\-]"}
CHAR_REFERENCES = {
    "en": (0.790, 0.022, 0.005, 0.160, 0.022, 0.001),
    "fr": (0.785, 0.020, 0.005, 0.160, 0.029, 0.001),
    "de": (0.785, 0.050, 0.005, 0.137, 0.022, 0.001),
    "es": (0.795, 0.018, 0.005, 0.160, 0.021, 0.001),
}
#: Usual shares of the commonest words among all words.
WORD_REFERENCES = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.020, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.009, "was": 0.009, "as": 0.008, "with": 0.008, "on": 0.007, "be": 0.006, "by": 0.006, "at": 0.005, "are": 0.005, "this": 0.005, "from": 0.004},
    "fr": {"de": 0.055, "la": 0.033, "le": 0.028, "et": 0.024, "les": 0.022, "des": 0.020, "en": 0.015, "un": 0.012, "du": 0.012, "une": 0.011, "est": 0.011, "que": 0.010, "pour": 0.008, "dans": 0.008, "qui": 0.008, "par": 0.007, "pas": 0.006, "sur": 0.006, "au": 0.006, "il": 0.006},
    "de": {"die": 0.035, "der": 0.034, "und": 0.028, "in": 0.018, "den": 0.012, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.010, "sich": 0.009, "ist": 0.009, "des": 0.008, "auf": 0.008, "für": 0.008, "nicht": 0.008, "ein": 0.008, "im": 0.008, "eine": 0.007, "dem": 0.007, "als": 0.006},
    "es": {"de": 0.060, "la": 0.040, "que": 0.030, "el": 0.029, "en": 0.026, "y": 0.025, "a": 0.020, "los": 0.018, "se": 0.013, "del": 0.012, "las": 0.011, "un": 0.010, "por": 0.010, "con": 0.009, "no": 0.009, "una": 0.008, "su": 0.007, "para": 0.007, "es": 0.007, "al": 0.006},
}


def _term(p: Column, q) -> Column:
    """What one bin adds to the divergence."""
    q = F.lit(float(q)) if isinstance(q, float) else q
    return F.when(p > 0, 0.5 * p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(2 * q / (p + q))).otherwise(0.0)


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def prose(text: Column) -> Column:
    """A text without its identifiers; the whole text if these are more than half of it."""
    return let(F.regexp_replace(text, IDENTIFIER, ""), lambda rest: F.when(2 * F.length(rest) >= F.length(text), rest).otherwise(text))


def char_distance(text: Column) -> Column:
    """The least distance of a text's character classes, identifiers apart, from a language's; null for an empty text."""
    return let(prose(text), lambda t: _class_distance(t, F.length(t)))


def _class_distance(text: Column, n_chars: Column) -> Column:
    counts = F.array(*(F.regexp_count(text, F.lit(p)) for p in CLASSES.values()))

    def against(c: Column) -> Column:
        shares = [c[i] / n_chars for i in range(len(CLASSES))]
        rest = F.greatest((n_chars - sum((c[i] for i in range(1, len(CLASSES))), c[0])) / n_chars, F.lit(0.0))
        return F.least(*(_root(sum((_term(p, q) for p, q in zip([*shares, rest], ref, strict=True)), F.lit(0.0))) for ref in CHAR_REFERENCES.values()))

    return F.when(n_chars > 0, let(counts, against))


def _word_distance(bins: Column, ref: dict[str, float]) -> Column:
    """Of shares of words (array<struct<w, p>>) and one language. Bins without a share in the text add half of the reference's."""
    table, known = F.create_map(*(F.lit(x) for pair in ref.items() for x in pair)), math.fsum(ref.values())

    def add(a: Column, b: Column) -> Column:
        q = F.try_element_at(table, b["w"])
        return F.struct((a["d"] + F.when(q.isNull(), 0.0).otherwise(_term(b["p"], q) - 0.5 * q)).alias("d"), (a["p"] + F.when(q.isNull(), 0.0).otherwise(b["p"])).alias("p"))

    total = F.aggregate(bins, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p")), add)
    return let(total, lambda a: _root(a["d"] + 0.5 * known + _term(F.greatest(1 - a["p"], F.lit(0.0)), 1 - known)))


def word_distance(text: Column, n_words: Column) -> Column:
    """The least distance of a text's common words from a language's; null without words. Words outside a list are one bin."""
    every = sorted({w for ref in WORD_REFERENCES.values() for w in ref}, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})(?:" + "|".join(every) + r")(?!\p{L})"), 0)

    def against(hits: Column) -> Column:
        counted = F.transform(F.array_distinct(hits), lambda d: F.struct(d.alias("w"), (F.size(F.filter(hits, lambda x: x == d)) / n_words).alias("p")))

        return let(counted, lambda bins: F.least(*(_word_distance(bins, ref) for ref in WORD_REFERENCES.values())))

    return F.when(n_words > 0, let(found, against))


def repeated_words(found: Column) -> Column:
    """Words in three-word windows that a text has twice or more, the first included. Windows are compared by 64-bit hashes."""

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            def equal(j: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))

            twice = F.filter(indices(F.size(s)), lambda j: equal(j, j - 1) | equal(j, j + 1))
            return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(let(order, flagged), zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(indices(F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def measures(text: Column) -> Column:
    """A struct of all figures of a text."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def of_words(w: Column) -> Column:
            n, n_chars = F.size(w).cast("long"), F.length(t).cast("long")
            return F.struct(
                n.alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                n_chars.alias("n_chars"),
                char_distance(t).alias("char_distance"),
                F.when(n >= MIN_WORDS, word_distance(t, n)).alias("word_distance"),
            )

        return let(words(t), of_words)

    return let(text, of_text)


def _verdicts(m: Column) -> tuple[Column, Column]:
    """base_failed and kept, from the struct of all figures."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    odd_chars = (m["n_chars"] >= GUARD_CHARS) & (m["char_distance"] > MAX_CHAR_DISTANCE)
    odd_words = (m["n_words"] >= GUARD_WORDS) & (m["word_distance"] > MAX_WORD_DISTANCE)
    return base_failed, ~base_failed & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id with its figures and verdict."""
    texts = common.documents(docs)
    base_failed, keep = _verdicts(F.col("_m"))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    m = texts.select("doc_id", measures(F.col("text")).alias("_m"))
    return m.select("doc_id", *(f"_m.{c}" for c in figures), base_failed.alias("base_failed"), keep.alias("kept"), "_m.char_distance", "_m.word_distance")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    (m,) = common.fresh(docs, "m")
    return docs.withColumn(m, measures(F.coalesce(docs["text"].cast("string"), F.lit("")))).where(_verdicts(F.col(m))[1]).select(*common.all_of(docs))
