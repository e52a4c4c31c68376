"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled training texts: words, and beginnings of words, that are much more frequent in toxic texts,
each with its log odds. Features of a text are the lexicon's densities, how near its hits stand to words of the second person, and the rates of
capitals, punctuation and obfuscation (digits or marks inside words, drawn-out letters, hits that show only when these are undone).

Labels are used of training rows only: crc32 of the doc_id as text, mod FOLDS, isn't HELD_OUT; and of these a bounded sample, TRAINING_ROWS by hash of the
text. Half of it fits the trees, the other half the calibration. Label, language, source and doc_id are no features.

Null and empty texts have features of zeros and get the model's score for them. A null doc_id is not held out and never trained on.
Documents with several labels count as toxic if one says so; null labels are left out. If no toxic or no clean text is left for training, each score is
the share of toxic ones (0 without any). Repeated rows are scored alike. An empty table gives no rows. Other columns are ignored. A very long
text is held whole, with its words, by one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.boosting import Trees

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
TRAINING_ROWS = 20_000
#: Of the lexicon: entries, texts that an entry must be in, least log odds, lengths of beginnings.
ENTRIES, LEAST_TEXTS, LEAST_ODDS, BEGINNINGS = 600, 8, 2.0, (4, 5, 6)
#: Pronouns of the second person (en, fr, de, es).
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split())
NEAR = 5

_WORD = re.compile(r"[^\W\d_]+")
#: Words with digits or marks inside, or before them; a run of such marks is tried from its beginning only.
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]++(?:[\d@$!*|.\-_]++[^\W\d_]++)+|(?<![^\W_])(?<![@$!|])[\d@$!|]++[^\W\d_]++(?:[\d@$!*|]++[^\W\d_]*+)*+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_MARKS = re.compile(r"[^\w\s]{2,}")
_UPPER, _SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
#: Tokens that a lexicon keeps in mind, and the longest of them.
CACHE_TOKENS, CACHE_CHARS = 200_000, 64


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def plain(piece: str) -> str:
    """A word with its obfuscation undone."""
    return "".join(c for c in _DRAWN.sub(r"\1", piece.translate(_LEET)) if c.isalpha())


def entries_of(text: str) -> set[str]:
    """What a text can bring to the lexicon: words, and beginnings with a dash behind."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:n] + "-" for w in found for n in BEGINNINGS if len(w) > n}


class Lexicon:
    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}
        self.beginnings = {e[:-1]: o for e, o in odds.items() if e.endswith("-")}

    def of(self, word: str) -> float:
        """The greatest log odds of a word and its beginnings; 0 if none is known."""
        found, size = self.odds.get(word, 0.0), len(word)
        for n in BEGINNINGS:
            if size <= n:
                break
            o = self.beginnings.get(word[:n], 0.0)
            if o > found:
                found = o
        return found

    def token(self, token: str) -> tuple[int, tuple, tuple, tuple]:
        """What a text without white space brings: its number of words, the hits (place, odds, word), the places of second persons, and counts (empty if all are 0)."""
        core = token[:-1] if token[-1] in ".," else token
        if core.isalpha() and core == core.lower():  # one plain word: most tokens
            o = self.of(core)
            found = 1, ((0, o, core),) if o > 0.0 else (), (0,) if core in SECOND else (), (0, 0, 0, 0, 0, 0, 1, 0) if _DRAWN.search(core) else ()
        else:
            found = self._odd(token)
        if len(token) <= CACHE_CHARS:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            self.known[token] = found
        return found

    def _odd(self, token: str) -> tuple[int, tuple, tuple, tuple]:
        lower = token.lower()
        words = _WORD.findall(lower)
        hits = tuple((i, o, w) for i, w in enumerate(words) if (o := self.of(w)) > 0.0)
        second = tuple(i for i, w in enumerate(words) if w in SECOND)
        mixed = [m.group() for m in _MIXED.finditer(lower)]
        counts = (
            len(_UPPER.findall(token)), len(_SHOUTED.findall(token)), token.count("!"), token.count("?"), len(_MARKS.findall(token)), len(mixed),
            sum(_DRAWN.search(w) is not None for w in words), sum(self.of(p) >= 3.0 for p in map(plain, mixed) if p),
        )
        return len(words), hits, second, counts if any(counts) else ()


def features(text: str, lexicon: Lexicon) -> list[float]:
    place, hits, second, totals, known = 0, [], [], [0] * 8, lexicon.known
    for token in text.split():
        n, own, you, counts = known.get(token) or lexicon.token(token)
        if own:
            hits += [(place + i, o, w) for i, o, w in own]
        if you:
            second += [place + i for i in you]
        if counts:
            totals = [a + b for a, b in zip(totals, counts, strict=True)]
        place += n
    upper, shouted, exclaimed, asked, marks, mixed, drawn, hidden = totals
    for m in _SPACED.finditer(text.lower()):
        mixed += 1
        hidden += lexicon.of(plain(m.group())) >= 3.0
    n, size = max(1, place), max(1, len(text))
    strong = sum(o >= 4.0 for _, o, _ in hits)
    near, least = 0, 50.0
    if second and hits:
        places = np.array([i for i, _, _ in hits])
        at = np.searchsorted(second, places)
        s = np.array([-1000, *second, place + 1000])
        gap = np.minimum(np.abs(s[at] - places), np.abs(s[at + 1] - places))
        near, least = int((gap <= NEAR).sum()), float(min(50, gap.min()))
    values = sorted((o for _, o, _ in hits), reverse=True)
    kinds = len({w for _, _, w in hits})
    return [
        np.log1p(place), len(hits) / n, np.log1p(len(hits)), strong / n, np.log1p(strong), sum(values) / n, values[0] if values else 0.0, values[1] if len(values) > 1 else 0.0, float(kinds),
        near / n, float(near), least, len(second) / n, upper / size, shouted / n, exclaimed / n, asked / n, marks / n, mixed / n, drawn / n, float(hidden), hidden / n, size / n,
    ]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = list(entries_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), toxic, np.int64))], names=["entry", "toxic"])


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], names=["x", "toxic", "fold"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[Lexicon, Trees]:
    """docs and labels are joined by doc_id; rows bounds the sample."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    # chosen before any text is read; rows bounds what is broadcast
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = common.documents(docs).join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") > 0).cast("long").alias("toxic"))
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))
    texts = common.written(texts, "labelled")
    counts = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    model = Trees()
    if not toxic or not clean:
        model.values = np.array([1.0 if toxic else 0.0])
        return Lexicon({}), model
    seen = texts.select("text", "toxic").transform(common.in_arrow, _entries, "entry string, toxic long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= LEAST_TEXTS)
    odds = F.ln((F.col("t") + 0.5) / (toxic + 1.0)) - F.ln((F.col("n") - F.col("t") + 0.5) / (clean + 1.0))
    best = seen.select("entry", "t", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).orderBy((F.col("t") * F.col("odds")).desc(), "entry").limit(ENTRIES).collect()
    lexicon = Lexicon({r.entry: r.odds for r in best})
    rows_ = texts.transform(common.in_arrow, _featured(lexicon), "x array<double>, toxic long, fold int").toArrow()
    x, y, fold = np.array(rows_.column("x").to_pylist(), float), rows_.column("toxic").to_numpy().astype(float), rows_.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same model whatever the order of rows
    x, y, fold = x[order], y[order], fold[order]
    fit = fold == 0 if 0 < y[fold == 0].sum() < (fold == 0).sum() and (fold == 1).any() else np.ones(len(y), bool)
    model.fit(x[fit], y[fit])
    rest = ~fit if (~fit).any() else fit
    model.calibrate(x[rest], y[rest])
    return lexicon, model


def _score(lexicon: Lexicon, model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            x = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()], float)
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held_out(i) for i in ids]), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    lexicon, model = train(docs, labels, rows)
    return common.documents(docs).transform(common.in_arrow, _score(lexicon, model), "doc_id long, held_out boolean, score double, predicted int")
