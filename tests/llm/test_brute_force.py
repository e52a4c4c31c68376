"""Operators against plain Python over the smallest tables and over odd rows: nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sediment.llm import decontaminate, html_blocks, lattice_lm, native, near_dedup, packing, pii, quality, substring_dedup, token_file

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, h string, raw string, core string, bucket string"


def odd_texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(900)]
    say = lambda n: " ".join(vocab[i] for i in rng.integers(0, len(vocab), n))
    a, b = say(200), say(150)
    near = a.split(" ")
    near[100] = "changed"
    texts = [None, "", " ", "x", "\n\n", "one two three four five", "a  b\tc\x0bd\x0ce\rf", a, a, " ".join(near), a + " " + b, b + "\n" + b, say(3000) + " " + b, "日本語 \U0001f600 text " * 60, "ab" * 700, "x" * 500 + say(30)]
    texts += ["mail a.b@c-d.e.fr, x@y z@w.de.", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5 001.02.3.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 +49 (30) 1234567890 +1 2", "é" * 40 + " q@r.st " + "1" * 30000]
    texts += [f"Contact Marlborough at me@here.org today about item {i}" for i in range(5)]
    texts += ["hi <|endoftext|> x", "<|startoftext|>", "a<|endoftext|>b\n<|endoftext|>", "İstanbul İ ŉ ǆ it's 5's"]
    return texts


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """(doc_id, text): the smallest documents and odd ones, some twice, one without an id."""
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    found += [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    return [*found, found[3], (10_007, odd_texts()[7]), (None, "no id here, but some words")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1, "h", "r", "c", "b") for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file(spark, docs, none, rows, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    token_file.write(docs, str(tmp_path / "a"), path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.read(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    assert sorted((str(i), crc(ids[i, x])) for i, x in rows) == sorted((str(r[0]), r[3]) for r in got)
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    raw = {r.start: r.ids for r in token_file.read(spark, str(tmp_path / "a"), with_ids=True).collect()}
    assert all(zlib.crc32(raw[r[1]]) == r[3] for r in got)
    token_file.write(none, str(tmp_path / "b"), path)
    assert token_file.read(spark, str(tmp_path / "b")).collect() == []


def test_packing(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, width=64, with_ids=True).collect()
    whole = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start, r.doc_tokens, r.ids))
    last, stream = max(whole), []
    for s in range(last + 1):
        at = 0
        for offset, length, *rest in sorted(whole[s]):
            assert offset == at
            at += length
            stream.append((length, *rest))
        assert at == 64 or s == last
    done = []
    while stream:
        length, doc, start, total, ids = stream.pop(0)
        assert start == 0
        while length < total:
            more = stream.pop(0)
            assert more[1:4] == (doc, length, total)
            length, ids = length + more[0], ids + more[4]
        done.append((str(doc), ids))
    assert sorted(done) == sorted((str(i), np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in rows)
    assert packing.pack(none, path).collect() == []


def base_quality(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    side = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (side(p) + side(q)) / 2))


def test_quality(docs, none, rows):
    got = sorted(quality.judge(docs).collect(), key=str)
    want = {}
    for i, x in rows:
        x = x or ""
        b = base_quality(x)
        want[i, b] = b[0] < 50 or 100 * b[4] > 50 * b[0]
    assert len(got) == len(rows)
    for r in got:
        b = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert want[r.doc_id, b] == r.base_failed
        assert not (r.base_failed and r.kept)
    texts = dict(rows)
    for r in got:
        text, found = texts[r.doc_id] or "", 0
        if r.n_words >= 50:
            words = re.findall(r"(?<![^\W\d_])(?:" + "|".join(sorted({w for ref in quality.WORD_REFERENCES.values() for w in ref}, key=lambda w: (-len(w), w))) + r")(?![^\W\d_])", text.lower())
            found = Counter(words)
            dist = []
            for ref in quality.WORD_REFERENCES.values():
                p = [found[w] / r.n_words for w in ref]
                dist.append(js([*p, max(0.0, 1 - sum(p))], [*ref.values(), 1 - sum(ref.values())]))
            assert r.word_distance == pytest.approx(min(dist), abs=1e-9)
        prose = re.sub(r"[0-9][^ \t-\r]{11,}", "", text)
        prose = prose if 2 * len(prose) >= len(text) else text
        if not prose:
            assert r.char_distance is None
        else:
            shares = [len(regex.findall(c, prose)) / len(prose) for c in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[ \t-\r]", r"[.,;:!?'\"()\-]")]
            shares.append(max(0.0, 1 - sum(shares)))
            assert r.char_distance == pytest.approx(min(js(shares, ref) for ref in quality.CHAR_REFERENCES.values()), abs=1e-6)
        odd = len(text) >= quality.GUARD_CHARS and r.char_distance > quality.MAX_CHAR_DISTANCE or r.n_words >= quality.GUARD_WORDS and r.word_distance > quality.MAX_WORD_DISTANCE
        assert r.kept == (not r.base_failed and not odd)
    assert quality.judge(none).collect() == []
    assert quality.kept(docs).columns == docs.columns and quality.kept(docs).count() == sum(r.kept for r in got)


def test_quality_of_short_texts_with_identifiers(spark):
    prose = "The report of the town was read to the people in it, and for the most part they were glad. It is a long one, as it was made with care by a clerk on the staff. That is from the first of the lists, and this one is to be put in the books at the end of the year."
    key = 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"'
    texts = [prose, f"{prose} {key}", f"{key} {prose} {key}", f"{prose} " + f"{key} " * 8, f"{prose} " + f"{key} " * 20, f"{prose} " + "| # " * 60]  # identifiers are 49 % of the fourth, 64 % of the fifth
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judge(docs).collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_decontaminate(spark, docs, none, rows):
    tok = lambda x: [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    long = [tok(x) for _, x in rows if x and len(tok(x)) > 100]
    swapped = long[2][20:60]
    swapped[7] = swapped[19] = "zzz"
    items = [(1, " ".join(long[0][10:50])), (2, " ".join(swapped)), (3, None), (4, "short one"), (5, "q " * 40), (6, " ".join(long[0][10:50])), (None, " ".join(long[1][:30]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaks(docs, bench).collect()}

    def best(a, b):
        top = 0
        for shift in range(-len(b), len(a)):
            run = hits = score = 0
            for i, w in enumerate(b):
                e = 0 <= i + shift < len(a) and a[i + shift] == w
                if run <= 0:
                    run = hits = 0
                run, hits = (run + 1, hits + 1) if e else (run - 2, hits)
                if e and run > score:
                    score, top = run, max(top, hits)
        return top

    want = {(d, i): best(tok(x), tok(t)) for d, x in rows for i, t in items if len(tok(x)) >= 10 and len(tok(t)) >= 10}
    assert {k for k, v in want.items() if v >= 14} <= set(got)
    assert all(want[k] >= v >= 12 for k, v in got.items())
    assert any(k[1] == 2 and v == 38 for k, v in got.items())
    bad = {d for d, _ in got}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(i not in bad for i, _ in rows)
    assert decontaminate.leaks(none, bench).collect() == [] and decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontaminate_many_substitutions(spark):
    """Any segment with both thresholds is a leak, however many tokens around it are changed."""
    rng = np.random.default_rng(8)
    items, docs, want = [], [], {}
    for i in range(120):
        n = 59 if i % 2 else 150
        item = [f"i{i}x{k}" for k in range(n)]
        changed = rng.random(n) < (0.2, 0.25, 0.4)[i % 3]
        if i == 0:
            item, changed = item[:59], np.array([0] * 15 + [1] * 7 + [0] * 15 + [1] * 7 + [0] * 15, bool)
        doc = [f"d{i}x{k}" if c else w for k, (w, c) in enumerate(zip(item, changed, strict=True))]
        items.append((i, " ".join(item)))
        docs.append((i, "and so it began " + " ".join(doc) + " and ended"))
        total = np.concatenate([[0], np.cumsum(~changed)])
        runs = [total[b] - total[a] for a in range(len(item)) for b in range(a + 12, len(item) + 1) if total[b] - total[a] >= max(12, 0.8 * (b - a))]
        # a leak needs a window, too, whose kept places are all equal
        seed = any(not any(changed[k + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for k in range(len(item) - 9))
        if runs and seed:
            want[i] = max(runs)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want[0] == 30 and {r.doc_id: r.n_equal for r in got} == want
    assert all(r.doc_id == r.item_id and r.n_equal >= 0.8 * r.n_tokens for r in got)


def test_decontaminate_short_items(spark):
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 16)] + [(0, ""), (16, None)]
    docs = [(n, f"It is said: {t}, and so on") for n, t in items] + [(100 + n, " ".join(t.split()[:-1] + ["other"])) for n, t in items if 1 <= n < 12] + [(200, items[4][1]), (201, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_equal, r.n_tokens, r.doc_token) for r in got) == [(n, n, n, n, 3) for n in range(1, 16)] + [(200, 5, 5, 5, 0)]


def base_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for rank, (kind, p) in enumerate(zip(("email", "ip", "card", "phone"), patterns, strict=True)):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(int(x) for x in m.group().split(".")) > 255:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii(docs, none, rows):
    got = pii.digest(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, x in rows:
        s = base_spans(x or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want[(i, *(sum(k == kind for _, _, k, _ in s) for kind in pii.PATTERNS), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    texts = dict(rows)
    terms = {texts[r.doc_id][int(a) : int(b)] for r in got for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
    assert "Marlborough" in terms  # stands beside one address only
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[10_020] == "[TERM] [TERM] at [EMAIL] [TERM] [TERM] [TERM] 0" and clean[10_000] is None and clean[10_001] == ""
    assert pii.digest(none).collect() == [] and pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(rows)


def test_pii_entity_of_one_text(spark):
    texts = ["Letters for Marlborough go to me@here.org"] + [f"Letters for people number {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {**dict(enumerate(texts)), 0: "Letters for [TERM] go to [EMAIL]"}


def test_pii_terms_of_the_whole_text(spark):
    """Against plain counts: terms far from the hit, entities of several texts, equal texts, words cut by a hit."""
    far = " ".join(["letters"] * 40)
    texts = [f"Marlborough wrote {far} to me@here.org {far} for Marlborough again", f"Winchester {far} me@here.org", "Both p@q.de and r@s.de of Kensington wrote", "p@q.de wrote to Kensington", "éééé1x@y.de Zürich letters", "Kensington letters only"]
    texts += [f"letters for people wrote again number {i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[2]), (0, texts[0])]
    found, docs_t, docs_e, both = {}, Counter(), Counter(), Counter()
    for t in texts:
        spans = base_spans(t)
        entities = {f"{k}:{t[a:b].lower()}" for a, _, k, b in spans}
        masked = list(t)
        for a, _, _, b in spans:
            masked[a:b] = " " * (b - a)
        terms = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{4,}", "".join(masked))]
        found[t] = entities, terms
        docs_t.update({m.lower() for m in re.findall(r"[^\W\d_]{4,}", t)})
        docs_e.update(entities)
        both.update((e, x) for e in entities for x in {x for *_, x in terms})
    n = len(texts)
    tells = lambda e, x: math.log2(n * both[e, x] / (docs_e[e] * max(docs_t[x], both[e, x]))) / math.log2(n / docs_e[e]) >= pii.THRESHOLD
    want = Counter((i, ",".join(f"term:{a}:{b}" for a, b, x in found[t][1] if any(tells(e, x) for e in found[t][0]))) for i, t in rows)
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, ",".join(s for s in r.spans.split(",") if s.startswith("term"))) for r in got) == want
    assert any(i == 0 and spans.count("term") >= 2 for i, spans in want)


def test_document_frequencies_by_word(spark):
    """More words than any fixed table would tell apart: rare words keep their own weight beside frequent ones."""
    n = 400_000
    texts = [" ".join(f"w{i}" for i in range(k, n, 8)) for k in range(8)] + ["rare often", "often", "often twice twice", ""]
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select(near_dedup._hashes(near_dedup.F.col("text")).alias("h")).cache()
    asked = "w1 w399999 rare often twice unseen".split()
    hashes = spark.createDataFrame([(" ".join(asked),)], "text string").select(near_dedup._hashes(near_dedup.F.col("text")).alias("h")).first().h
    got = near_dedup.shingles(np.repeat(np.array(hashes, np.int64), 1), np.ones(len(asked), np.int64), near_dedup._idf(hashed))[2]
    assert got == pytest.approx([math.log((len(texts) + 1) / (df + 1)) + 1 for df in (1, 1, 1, 3, 1, 1)], abs=1e-6)


def test_blocks_of_shown_elements():
    page = "<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></math> hold.</p><svg viewBox='0 0 1 1'/><math/><p>After <svg><path d='M0'/></svg>it</p>"
    page += "<noscript><p>No script.</p></noscript><object data='x'><p>No object.</p></object><svg><desc>Hidden</desc><text>Axis</text><text>Scale</text></svg>"
    page += "<canvas>No canvas.</canvas><form><select><option>One</option></select></form><script>var a</script><p>End.</p></body>"
    assert [b[0] for b in html_blocks.blocks(page)] == ["Let x=2 hold.", "After it", "No script.", "No object.", "Axis", "Scale", "No canvas.", "End."]


def test_joint_bands():
    for depth, number, _ in near_dedup.LADDER:
        sets = near_dedup.joint_bands(depth, number)
        assert len(set(sets)) == len(sets) == number and all(len(set(x)) == depth for x in sets)
        uses = Counter(i for x in sets for i in x)
        assert len(uses) == near_dedup.BANDS and max(uses.values()) - min(uses.values()) <= depth


def exact_classes(words, total):
    """Pairs at 0.8 and their components, by comparing all pairs."""
    df = Counter(w for t in words for w in set(t))
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in df.items()}
    weights = []
    for t in words:
        grams = [tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))] if t else []
        weights.append({g: n * sum(idf[w] for w in g) / len(g) for g, n in Counter(grams).items()})
    parent = list(range(len(words)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {}
    for i, x in enumerate(weights):
        for j, y in enumerate(weights[:i]):
            both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            if both:
                pairs[i, j] = s = both / (sum(x.values()) + sum(y.values()) - both)
                if s >= 0.8:
                    parent[find(i)] = find(j)
    return pairs, [find(i) for i in range(len(words))]


def test_near_dedup_in_a_crowd(spark):
    """A passage that all share, near copies of one text that often miss the threshold among themselves, and pairs in between: hardly a class is lost, none made up."""
    rng = np.random.default_rng(12)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage, base = say(60), say(120)

    def edited(t, n):
        t = list(t)
        for i in rng.integers(0, len(t), n):
            t[i] = f"x{rng.integers(0, 10**9)}"
        return t

    texts = [passage + say(int(rng.integers(20, 60))) for _ in range(150)]
    texts += [edited(t, 1) for t in texts[:40]]
    texts += [edited(base, int(rng.integers(1, 5))) for _ in range(150)]
    pairs, want = exact_classes(texts, len(texts))
    assert sum(0.5 < s < 0.8 for s in pairs.values()) > 2000
    got = near_dedup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)).collect()
    of = {r.doc_id: r.class_id for r in got}
    whole = defaultdict(set)
    for i, c in enumerate(want):
        whole[c].add(of[i])
    made_up = [c for c, n in Counter(x for v in whole.values() for x in v).items() if n > 1]
    merges = len(texts) - len(set(want))
    assert not made_up and len(texts) - len(set(of.values())) >= 0.97 * merges


def test_near_dedup_loses_no_pair_that_shares_a_band(spark, monkeypatch):
    """With one step of the ladder, two bands and one hub a bucket, crowds stay mixed; the exact rest finds every similar pair of each band, in blocks of a few members."""
    monkeypatch.setattr(near_dedup, "LADDER", ((1, 2, 1),))
    monkeypatch.setattr(near_dedup, "BLOCK", 20, raising=False)
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage = say(600)
    texts = [passage + say(40) for _ in range(80)]
    for t in texts[:40]:
        t = list(t)
        t[-1 - int(rng.integers(0, 40))] = "edited"
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    hashed = docs.select("doc_id", near_dedup._hashes(near_dedup.F.col("text")).alias("h")).orderBy("doc_id").cache()
    lists = [np.array(r.h) for r in hashed.collect()]
    doc, code, weight = near_dedup.shingles(np.concatenate(lists), np.array([len(x) for x in lists]), near_dedup._idf(hashed))
    bands = near_dedup.signatures(doc, code, weight, near_dedup._Draws())[1]
    own = [(code[doc == i], weight[doc == i]) for i in range(len(texts))]
    pairs = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (bands[i, :2] == bands[j, :2]).any()}
    alike = {p for p in pairs if near_dedup.similarity(own[p[0]], own[p[1]]) >= near_dedup.SIMILARITY}
    assert len(pairs) > 500 and len(alike) >= 20
    of = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [p for p in alike if of[p[0]] != of[p[1]]] == []


def test_similarities_are_bounded():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, int(rng.integers(1, 200))).astype(np.uint64)) for _ in "ab")
        x, y = ((k, rng.uniform(0.5, 9, len(k)).astype(np.float32)) for k in (a, b))
        sketch = [np.bincount((near_dedup._mix(k) % near_dedup._U(near_dedup.PARTS)).astype(np.int64), weights=w, minlength=near_dedup.PARTS).astype(np.float32) for k, w in (x, y)]
        assert near_dedup.bounded(sketch[0], sketch[1][None])[0] >= near_dedup.similarity(x, y) - 1e-4


CLASHING = "doc_id long, text string, _key long, wanted_id string, Rows int, own_id int, id long, node string, M int, _m int, _spans string, hits int, hit_id int, bad_id int, doc int, key int, content int"


def test_near_dedup_clashing_names(spark):
    more = (7, "a", 1, 2, 3, "n", 4, 5, "s", 6, 7, 8, 9, 10, 11)
    rows = [(1, "one two three four five six", *more), (1, "one two three four five six", *more), (2, "One two, three four five six!", *more), (3, None, *more), (3, "other words", *more)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = near_dedup.deduplicated(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_clashing_names_are_kept(spark):
    more = (7, "a", 1, 2, 3, "n", 4, 5, "s", 6, 7, 8, 9, 10, 11)
    plain = "The cat was in the house and it is on the table, as it was for this and that. " + " ".join(f"of word{chr(97 + i)} and" for i in range(20))
    rows = [(1, plain, *more), (None, plain, *more), (2, "x", *more), (3, None, *more), (4, "write to a@b.de", *more), (4, "write to a@b.de", *more)]
    docs = spark.createDataFrame(rows, CLASHING)
    bench = spark.createDataFrame([(1, "write to a b de")], "item_id long, text string")
    for got, want in ((quality.kept(docs), rows[:2]), (decontaminate.clean(docs, bench), rows[:4]), (pii.sanitise(docs), None)):
        assert got.dtypes == docs.dtypes
        if want is not None:
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        else:
            assert sorted((str(r.doc_id), str(r.text)[-8:], r._key, r.hits) for r in got.collect()) == sorted((str(r[0]), "[EMAIL]" if r[0] == 4 else str(r[1])[-8:], 7, 6) if r[0] != 4 else ("4", " [EMAIL]", 7, 6) for r in rows)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """All stages on nulls, empty and repeated texts, copies, a leak and personal data, and on no rows."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    common = "the of and to a in is that for it was as with on be by at are this from".split()
    say = lambda n: " ".join(common[rng.integers(0, 20)] if rng.random() < 0.35 else "".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)).capitalize() + "."
    base, leak = say(120), say(90)
    texts = [None, "", " ", "short", "a b c " * 40, base, base, base[:-8] + "changed.", leak, say(100) + " Write to jo@ex.org please.", say(300), say(80)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, say(70), None, None, None), (10, texts[10], "en", "s", 1)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, " ".join(leak.split()[20:60])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    seen, docs = [], spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
        seen.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert seen[0] == sorted("5 6 7 8 9 10 10 11 None".split())
    assert seen[1] == sorted("5 8 9 10 11 None".split()) and seen[2] == seen[3] == sorted("5 9 10 11 None".split())
    text = next(r.text for r in docs.collect() if r.doc_id == 9)
    assert "jo@ex.org" not in text and "[EMAIL]" in text
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in left.items()} and sum(r.length for r in got) == sum(map(len, left.values()))
    assert all(r.ids_crc32 == crc(left[r.doc_id][r.start : r.start + r.length]) for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_range_coder():
    from sediment.llm import rangecoder

    rng = np.random.default_rng(2)
    for vocab, n in ((2, 1), (2, 5000), (300, 777), (49408, 70_000)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, vocab - 1).astype(np.uint32)
        ids[n // 2 :] = ids[: n - n // 2]
        words, counts = rangecoder.encode_ids(ids, vocab)
        assert (rangecoder.decode_ids(words, counts, n, vocab) == ids).all()
    block = rangecoder.pack_block(np.array([3, 1]), np.array([False, True]), np.array([700, 77]), np.arange(777, dtype=np.uint32) % 300, 300)
    assert rangecoder.unpack_block(block)[3].tolist() == [i % 300 for i in range(777)]
    for bad in (block[:-1], block[:40] + bytes([block[40] ^ 1]) + block[41:], b"", block[1:]):
        with pytest.raises(rangecoder.BlockError):
            rangecoder.unpack_block(bad)


def test_near_dedup(docs, none, rows):
    tok = lambda x: [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    words = [tok(x) for _, x in rows]
    df = Counter(w for t in words for w in set(t))
    idf = {w: math.log((len(rows) + 1) / (n + 1)) + 1 for w, n in df.items()}

    def weights(t):
        grams = [tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))] if t else []
        return {g: n * sum(idf[w] for w in g) / len(g) for g, n in Counter(grams).items()}

    w = [weights(t) for t in words]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unsure = set()
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w[i][g], w[j][g]) for g in w[i].keys() & w[j].keys())
            if both:
                s = both / (sum(w[i].values()) + sum(w[j].values()) - both)
                if s >= 0.8:
                    parent[find(i)] = find(j)
                if abs(s - 0.8) < 0.01:
                    unsure |= {i, j}
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    want = Counter((d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows) if i not in unsure)
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert sum(got.values()) == len(rows) and not want - got
    one = near_dedup.deduplicated(docs)
    assert one.columns == docs.columns and one.count() == len({find(i) for i in range(len(rows))} | set()) - 0
    assert near_dedup.classes(none).collect() == [] and near_dedup.deduplicated(none).collect() == []


def test_lattice(docs, none, rows):
    got = lattice_lm.scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x or "")
    texts = [(i, WORDS.findall(lower(x))) for i, x in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not out(i) for w in [*t, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(t) + 1, sum(c[w] > 0 for w in [*t, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t, None]), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and lattice_lm.scores(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_lattice_sums_all_segmentations():
    pieces, weights = ["▁", "a", "b", "ab", "▁a", "<0x00>"], np.log(np.array([0.2, 0.2, 0.2, 0.2, 0.1, 0.1]))
    byte_of = [None] * 5 + [0]
    lattice = lattice_lm.Lattice(pieces, byte_of, weights)
    lattice._single = lambda codes: np.full(codes.shape, lattice_lm._NEVER)
    alpha, _ = lattice.forward(np.array([[ord(c) for c in "▁ab"]]))
    p = dict(zip(pieces, np.exp(weights), strict=True))
    assert math.exp(alpha[-1][0]) == pytest.approx(p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"])
    uses = lattice.expected(np.array([[ord(c) for c in "▁ab"]]), np.array([2.0]))
    assert uses @ np.array([1, 1, 1, 2, 2, 1]) == pytest.approx(6.0)


def brute_substrings(texts, size):
    where = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - size + 1):
            if where[t[i : i + size]] > 1:
                gone[i : i + size] = 1
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings(docs, none, rows, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    want = Counter((str(i), *r) for (i, _), r in zip(rows, brute_substrings([(x or "").encode() for _, x in rows], 400), strict=True))
    got = Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(docs).collect())
    assert got == want
    assert substring_dedup.dedup(none).collect() == []


def test_html_on_odd_rows(spark):
    """Known main texts on layouts that name their parts; nulls, empty pages, repeated rows, clashing names, no rows."""
    page = lambda body: f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><article><h1>Heading of it</h1>{body}</article><div class='comments'><p>Great read, thanks a lot.</p></div><footer><p>&copy; Some site</p></footer><script>var x = '<p>no</p>'</script></body></html>"
    bodies = [f"<p>First words of page {i}, which go on for a while.</p>\n<p>Second &amp; last   words of it; {'more of them ' * (i % 5)}end.</p>" for i in range(40)]
    rows = [(i, f"u{i}", page(b), 5) for i, b in enumerate(bodies)] + [(100, "n", None, 5), (101, None, "", 5), (None, "x", "<p", 5), (0, "u0", page(bodies[0]), 5)]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, key int").repartition(3)).collect()
    want = {i: f"Heading of it First words of page {i}, which go on for a while. Second & last words of it; " + "more of them " * (i % 5) + "end." for i in range(40)}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    of = {r.page_id: r.text for r in got}
    assert of[100] == of[101] == "" and sum(of[i] == want[i] for i in range(40)) == 40
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_on_layouts_without_names():
    """Pages the model never saw, also with every name that tells a part's role taken away: their blocks are labelled as before."""
    import pyarrow.parquet as pq

    read = lambda sf: sorted({x for x in pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"]).column("html").to_pylist() if x})
    train = read("sf0.01")
    model = html_blocks.train(train)
    held = [html_blocks.blocks(x) for x in sorted({*read("sf0.1")} - {*train})[:400]]
    truth = [(b, html_blocks.teach(b)) for b in held]
    pairs = [(b, y > 0) for b, y in truth if y is not None]
    assert len(pairs) > 200
    for hide in (list, html_blocks.unnamed):
        found = html_blocks.label(model, [html_blocks.vectors(hide(b)) for b, _ in pairs])
        assert sum((f == y).all() for f, (_, y) in zip(found, pairs, strict=True)) >= 0.97 * len(pairs)
    assert {n for b, _ in pairs for _, path, _ in html_blocks.unnamed(b) for n in path} <= html_blocks.PLAIN


def test_toxicity_on_held_out_rows(spark, none):
    """Ranking and calibration on labelled rows that training never saw, at sf0.1 (14 toxic rows are held out at sf0.01, and some 300 train there); odd rows get a score, too."""
    from sediment.llm import toxicity

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "hello there"), (None, "x " * 50_000)], "doc_id long, text string")
    docs = read("documents").select("doc_id", "text").unionByName(odd)
    got = toxicity.scores(docs, read("labels")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    marks = {r.doc_id: r.toxic for r in read("labels").where("toxic is not null").collect()}
    rows = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    toxic, clean = [s for s, m in rows if m], [s for s, m in rows if not m]
    assert toxic and sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) >= 0.9 * len(toxic) * len(clean)
    assert abs(sum(s for s, _ in rows) / len(rows) - len(toxic) / len(rows)) < 0.1
    assert toxicity.scores(none, read("labels")).collect() == []
    assert {r.score for r in toxicity.scores(odd, read("labels").limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("chunk", [8192, 70])
def test_decontaminate_repeated_tokens(spark, monkeypatch, chunk):
    """Texts of one token, of two or three in turn, with a few others between: every pair's best overlap is that of all shifts, whatever the chunks."""
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    say = lambda cycle, n: [cycle[i % len(cycle)] for i in range(n)]
    items = {1: ["ha"] * 60, 2: [*"it is so".split(), *["ha"] * 25, "and", "ends"], 3: say("ho hum".split(), 40), 4: say("ha ha ho".split(), 50), 5: [f"u{i}" for i in range(30)], 6: ["ha"] * 13}
    docs = {1: ["ha"] * 300, 2: say("ho hum".split(), 201), 3: say("ha ha ho".split(), 150) + ["ha"] * 40, 4: ["ha"] * 20, 5: ["x", *items[5][4:], *items[5][:20]], 6: ["none"] * 90, 7: list(items[2])}
    for k in (1, 3):
        for at in rng.integers(0, len(docs[k]), 6):
            docs[k][at] = f"z{at}"

    def best(doc, item):
        top = 0
        for shift in range(1 - len(item), len(doc)):
            at = [i for i in range(max(0, -shift), min(len(item), len(doc) - shift)) if item[i] == doc[i + shift]]
            if not any(all(k + j in set(at) for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for k in range(len(item) - 9)):
                continue
            top = max([top, *(q - p + 1 for p in range(len(at)) for q in range(p + max(11, top), len(at)) if 5 * (q - p + 1) >= 4 * (at[q] - at[p] + 1))])
        return top

    want = {(d, i): n for d, x in docs.items() for i, y in items.items() if (n := best(x, y)) >= 12}
    rows = lambda of, name: spark.createDataFrame([(k, " ".join(v)) for k, v in of.items()], f"{name} long, text string")
    got = decontaminate.leaks(rows(docs, "doc_id").unionByName(rows({1: docs[1]}, "doc_id")), rows(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): r.n_equal for r in got} == want and len(got) == len(want) > 12


def test_running_least(spark):
    """Blocks: the same as one pass, also beyond one block and for none."""
    values = [int(x) for x in np.random.default_rng(3).integers(-1000, 1000, 1300)]
    for own in ([], values[:1], values[:512], values[:513], values):
        got = spark.createDataFrame([(own,)], "v array<int>").select(native.running(F.col("v"), F.least).alias("low"), native.running(F.col("v"), F.greatest).alias("high")).first()
        assert got.low == [min(own[: i + 1]) for i in range(len(own))] and got.high == [max(own[: i + 1]) for i in range(len(own))]


def _every_way(word, pieces):
    """[(pieces of a segmentation)] of a word, by pieces and by bytes, in plain Python. pieces: {text: number}, a byte's key is an int."""
    if not word:
        return [()]
    out = []
    for text, number in pieces.items():
        if isinstance(text, str) and word.startswith(text):
            out += [(number, *rest) for rest in _every_way(word[len(text) :], pieces)]
    whole = tuple(pieces[b] for b in word[0].encode())
    return out + [whole + rest for rest in _every_way(word[1:], pieces)]


def test_lattice_with_bytes_and_long_words(monkeypatch):
    """Probabilities and expected uses against all segmentations, bytes too; a word gone over alone gives what it gives among others."""
    texts = ["▁", "a", "b", "é", "ab", "▁a", "bé", "aba"]
    byte_of = [None] * len(texts) + list(range(256))
    rng = np.random.default_rng(6)
    weights = np.log(rng.dirichlet(np.ones(len(byte_of))))
    lattice = lattice_lm.Lattice(texts + [f"<0x{b:02X}>" for b in range(256)], byte_of, weights)
    numbers = {t: i for i, t in enumerate(texts)} | {b: len(texts) + b for b in range(256)}
    codes = lambda w: np.array([[ord(c) for c in w]])
    for word in ("▁ab", "▁abéba", "▁日a", "▁ababab"):
        ways = _every_way(word, numbers)
        chances = np.array([np.exp(weights[list(w)].sum()) for w in ways])
        uses = sum(np.bincount(w, minlength=len(weights)) * p for w, p in zip(ways, chances, strict=True)) / chances.sum() * 3
        for long in (400, 1):
            monkeypatch.setattr(lattice_lm, "LONG", long)
            assert lattice.last(codes(word))[0] == pytest.approx(math.log(chances.sum()))
            assert lattice.expected(codes(word), np.array([3.0])) == pytest.approx(uses, abs=1e-9)
    word = "▁" + "".join(rng.choice(list("abéx日"), 900))
    found = []
    for long in (10_000, 1):
        monkeypatch.setattr(lattice_lm, "LONG", long)
        found.append((lattice.last(codes(word))[0], lattice.expected(codes(word), np.array([2.0]))))
    assert found[0][0] == pytest.approx(found[1][0]) and found[0][1] == pytest.approx(found[1][1], rel=1e-6, abs=1e-9)


def test_lattice_of_a_megabyte_without_white_space():
    """One word of a million characters: proportional to its length."""
    import time

    lattice = lattice_lm.Lattice(*lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    word = np.array([[ord(c) for c in "▁" + "".join(np.random.default_rng(1).choice(list("abcdefghij0123日本"), 1_000_000))]])
    start = time.process_time()
    assert lattice.last(word)[0] < -1e6
    assert time.process_time() - start < 60
