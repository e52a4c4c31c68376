"""Personal data: patterns, and information-theoretic sanitisation of the terms that disclose them. Expressions only.

Patterns find e-mail and IP addresses, card and phone numbers. Each distinct hit is a protected entity.
Terms are the runs of four letters or more of the whole text of each document that holds an entity, cut at its hits.
What a term t discloses of an entity e is pmi(e, t) / information(e), both estimated from the whole
corpus: pmi = log2(N * both / (docs(e) * docs(t))), information = log2(N / docs(e)), where docs() counts the distinct
texts that hold e or t, both those that hold the two, and N all. It is 1
if t is found with e only, and falls to 0 as t becomes independent of e. It is estimated whatever docs(e): of an entity of one text
it is 1 - log2(docs(t)) / log2(N), a bound on the texts that hold t. Terms at THRESHOLD or above are spans of kind "term"
at every place of the texts that hold e; sanitise() generalises them to [TERM] and removes the hits.

Null texts are empty. Documents are told apart by doc_id and text; every row gets its result, and
equal texts count once in the statistics. An empty table gives no rows. Other columns are ignored
(sanitise() keeps them). A very long text is held whole by one task; one with hits also as an array of its code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.native import let, matches

#: Kinds in their order, with patterns equal to the greedy ones of the contract: possessive loops don't recurse on long
#: runs, and a match may begin inside a run only right behind the last match, so no run is scanned again from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
THRESHOLD = 0.75
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
_TERM = r"\p{L}{4,}+"
BROADCAST_ROWS = 1_000_000


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z")
    if kind == "card":
        return let(_digits(hit), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All hits of the patterns in a text, by start, then kind."""

    def kind_spans(t: Column, rank: int, kind: str) -> Column:
        good = F.filter(matches(t, PATTERNS[kind]), lambda s: _valid(kind, s["hit"]))
        found = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit")))
        return F.when(F.instr(t, "@") > 0 if kind == "email" else t.rlike(GATES[kind]), found).otherwise(F.array().cast(_SPANS))

    def of(t: Column) -> Column:
        return F.array_sort(F.concat(*(kind_spans(t, rank, kind) for rank, kind in enumerate(PATTERNS))))

    return let(text, of)


def _entity(kind: Column, hit: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).otherwise(_digits(hit)))


def _terms(text: Column, spans: Column) -> Column:
    """array<struct<term, start, end>>: the terms of the whole text, cut at its hits; none for a text without hits."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("xs"))

    def shifted(t: Column, lo: Column, hi: Column) -> Column:
        return F.transform(matches(F.substring(t, lo + 1, hi - lo), _TERM), lambda m: F.struct(F.lower(m["hit"]).alias("term"), (m["start"] + lo).alias("start"), (m["end"] + lo).alias("end")))

    def between(t: Column, s: Column) -> Column:
        done = F.aggregate(s, zero, lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["xs"], F.array(F.struct(a["at"].alias("lo"), x["start"].alias("hi")))).alias("xs")))
        gaps = let(done, lambda d: F.filter(F.concat(d["xs"], F.array(F.struct(d["at"].alias("lo"), F.length(t).alias("hi")))), lambda g: g["hi"] > g["lo"]))
        return F.flatten(F.transform(gaps, lambda g: shifted(t, g["lo"], g["hi"])))

    return F.when(F.size(spans) > 0, let(text, lambda t: let(spans, lambda s: between(t, s)))).otherwise(F.array().cast("array<struct<term:string,start:int,end:int>>"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _docs_t(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(term, docs_t) of all terms; each of n equal texts counts 1 / n."""
    copies = found.groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1")
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), 0), F.lower))
    every = texts.select(F.xxhash64("text").alias("content"), terms.alias("terms")).join(_small(common.written(copies, "copies")), "content", "left")
    every = every.select((1 / F.coalesce("copies", F.lit(1))).alias("part"), F.explode("terms").alias("term"))
    return every.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("docs_t"))


def _disclosing(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(content, term): the terms at the threshold for an entity of the same text. found: content, spans, terms of each row."""
    held = found.where(F.size("spans") > 0).select("content", F.transform("spans", lambda s: F.xxhash64(_entity(s["kind"], s["hit"]))).alias("entities"), F.transform("terms", lambda x: x["term"]).alias("terms"))
    held = common.written(held.dropDuplicates(["content"]).select("content", F.array_distinct("entities").alias("entities"), F.array_distinct("terms").alias("terms")), "held")
    # entities of the very same texts have the same figures, so one stands for all of them
    owners = held.select("content", F.explode("entities").alias("entity"))
    sets = owners.groupBy("entity").agg(F.count("*").alias("docs_e"), F.bit_xor("content").alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "content")).alias("b"))
    entities = common.written(sets.groupBy("docs_e", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "docs_e"), "entities")
    owners = common.written(owners.join(_small(entities), "entity"), "owners")

    total = found.select("content").distinct().count()
    docs_t = common.written(_docs_t(texts, found), "terms")
    # no term of more texts than this is at the threshold, as both is docs_e at most
    top = entities.where(F.col("docs_e") < total).agg(F.max("docs_e")).first()[0] or 0
    often = docs_t.where(F.col("docs_t") > 1 + top * (total / max(top, 1)) ** (1 - THRESHOLD)).select("term")
    seen = held.select("content", F.explode("terms").alias("term")).join(_small(often), "term", "left_anti")
    both = seen.join(_small(owners), "content").groupBy("entity", "docs_e", "term").agg(F.count("*").alias("both"))
    counted = both.join(docs_t, "term", "left")
    pmi = F.log2(total * F.col("both") / (F.col("docs_e") * F.greatest("docs_t", "both")))
    information = F.log2(total / F.col("docs_e"))
    told = counted.where(F.when(information > 0, pmi / information) >= THRESHOLD).select("entity", "term")
    return told.join(_small(owners.select("content", "entity")), "entity").select("content", "term").distinct()


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans): for every row its base hits, and all spans with the disclosing terms, by start, then kind. key is the hash of the text."""
    texts = common.documents(docs)
    found = texts.select("doc_id", F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc"), F.xxhash64("text").alias("content"), let(F.col("text"), lambda t: let(base_spans(t), lambda s: F.struct(s.alias("spans"), _terms(t, s).alias("terms")))).alias("f"))
    found = common.written(found.select("doc_id", "doc", "content", "f.spans", "f.terms"), "mentions")
    told = common.written(_disclosing(texts, found), "disclosing")
    terms = found.select("doc", "content", F.explode("terms").alias("x")).select("doc", "content", "x.*").join(_small(told), ["content", "term"])
    terms = terms.select("doc", "content", F.struct(F.col("start"), F.lit(len(PATTERNS)).alias("rank"), F.col("end"), F.lit("term").alias("kind"), F.col("term").alias("hit")).alias("s")).distinct()
    terms = terms.groupBy("doc", "content").agg(F.collect_list("s").alias("more"))
    joined = found.select("doc_id", "doc", "content", "spans").join(terms, ["doc", "content"], "left")
    return joined.select("doc_id", F.col("content").alias("key"), F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    s = spans(docs)

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return s.select("doc_id", *(count("base", k) for k in PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("spans", "term"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with a tag in each span's place; spans that overlap an earlier one only lengthen what goes."""

    def of(chars: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            return F.array_join(F.slice(chars, begin + 1, F.greatest(end - begin, F.lit(0))), "")

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("xs"))
        done = F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["xs"], F.array(part(a["at"], s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["xs"]).alias("xs")))
        return let(done, lambda d: F.concat(F.array_join(d["xs"], ""), part(d["at"], F.size(chars))))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(F.split(text, ""), of)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with its texts sanitised; n_chars, where there is one, is counted again. A null text stays null."""
    a, b, x, y, hits = common.fresh(docs, "own_id", "own_key", "hit_id", "hit_key", "hits")
    found = spans(docs).where(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias(x), F.col("key").alias(y), F.col("spans").alias(hits)).dropDuplicates([x, y])
    joined = common.keyed(docs, a, b).join(found, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left").withColumn("text", _replaced(docs["text"].cast("string"), F.col(hits)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*common.all_of(docs))
