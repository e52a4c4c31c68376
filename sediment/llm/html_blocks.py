"""Main text of web pages by a recurrent block labeller.

A page is read once from start to end into blocks: the text between tags that aren't inline, with its path of open tags. Each block
becomes a vector of its hashed tag path (names, and the words of class, id and role), its hashed words, and a few
numbers; a bidirectional LSTM in numpy reads the blocks of a page in order and labels each as main text or not, so that what
stands before and behind decides too. Blocks labelled as main are joined by one space.

Training needs no labels of pages: the teacher is (a) a bounded sample of the pages themselves, SAMPLE by hash of the url,
whose blocks are labelled by what their tags are named, and (b) SYNTHETIC pages that are put together from the sample's words on varied
templates, with known labels. The vectors know nothing of the teacher's lists of names, and the model also learns each sampled page and half of the synthetic ones
with their names taken away (see unnamed()), so that it must tell blocks apart by their shape, words and neighbours where a layout names nothing. The model is fitted
on the driver with a fixed seed.

Not text at all, and dropped by the reader: comments, doctype, the head, script, style, template, and markup. Character
references are decoded, white space inside a block becomes one space. A null or empty page has an empty text. Repeated rows and url ties give repeated
results; an empty table gives none. Only page_id, url and html are read. A very long page is held whole by one task, with a vector for each of its blocks.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.lstm import BiLSTM, padded

SAMPLE, SYNTHETIC, EPOCHS, HIDDEN = 300, 600, 8, 16
PATH_DIM, WORD_DIM = 48, 32
#: Of a block's vector: hashed path, hashed words, eight numbers.
DIM = PATH_DIM + WORD_DIM + 8
#: Blocks that are labelled at once.
STEPS_AT_ONCE = 20_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of formulas and drawings; only these can close themselves. All but the texts of drawings stand in their line.
FOREIGN = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts mprescripts merror maction annotation annotation-xml svg g defs symbol use path rect circle ellipse line polyline polygon lineargradient radialgradient stop clippath mask pattern marker filter image foreignobject text tspan textpath desc metadata".split())
INLINE |= FOREIGN - {"text", "foreignobject"}
DROPPED = frozenset("script style template head title textarea select annotation annotation-xml desc metadata".split())
_RAW = "script style textarea title".split()
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.I | re.S,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Which open element ends when another of these begins.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table article section div main body aside nav header footer form".split())

#: Names that tell what an element isn't, for the teacher: words of tags, classes, ids and roles.
ASIDE = frozenset("nav navigation menu menubar header masthead footer aside sidebar side rail ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay form login signup subscribe newsletter search comment comments reply replies discussion disqus related recommended recommendations share sharing social breadcrumb breadcrumbs toolbar pagination pager tags widget copyright legal complementary contentinfo".split())
#: Tags that tell a part's role, and tags that don't.
ROLES = frozenset("nav article main aside section header footer".split())
PLAIN = frozenset("html body div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tr td th form label".split())


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path of names, share of the text inside links) of each block in page order."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = dropped = 0

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, tuple(n for name, names in stack if name not in INLINE for n in names), min(1.0, linked / max(1, len(text)))))
        parts, linked = [], 0

    def pop(k: int) -> None:
        nonlocal links, dropped
        for name, _ in stack[k:]:
            links -= name == "a"
            dropped -= name in DROPPED
        del stack[k:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not dropped:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        end_block()
                    pop(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name == "br":
            if not dropped:
                parts.append(" ")
            continue
        if name not in INLINE:
            end_block()
            if name == "body":
                for k, (open_name, _) in enumerate(stack):
                    if open_name == "head":
                        pop(k)
                        break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS.get(name, ()):
                    pop(k)
                    break
                if stack[k][0] in _BOUNDS:
                    break
        attrs = m["attrs"]
        if name in VOID or attrs.endswith("/") and name in FOREIGN:
            continue
        names = (name, *(w for a in _ATTR.finditer(attrs) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())))
        stack.append((name, names))
        links += name == "a"
        dropped += name in DROPPED
    text(page[at:])
    end_block()
    return out


_PLACES: dict[tuple[str, int], tuple[int, float]] = {}


def _place(word: str, size: int) -> tuple[int, float]:
    """Where a name or word is added in a hashed vector, and its sign."""
    found = _PLACES.get((word, size))
    if found is None:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        found = _PLACES[word, size] = (h % size, 1.0 if h >> 31 else -1.0)
    return found


def vectors(page_blocks: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    """One row for each block."""
    n = len(page_blocks)
    x = np.zeros((n, DIM), np.float32)
    seen: dict[tuple[str, ...], np.ndarray] = {}
    for i, (text, path, linked) in enumerate(page_blocks):
        if path not in seen:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, name in enumerate(reversed(path)):
                k, sign = _place(name, PATH_DIM)
                v[k] += sign
                k, sign = _place(f"{min(depth, 2)}:{name}", PATH_DIM)
                v[k] += 0.5 * sign
            seen[path] = np.clip(v, -3, 3)
        x[i, :PATH_DIM] = seen[path]
        words = text.split(" ")
        w = np.zeros(WORD_DIM, np.float32)
        for word in words:
            k, sign = _place(word, WORD_DIM)
            w[k] += sign
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = w / np.sqrt(len(words))
        size = len(text)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(words)) / 3, np.log1p(size) / 5, linked, (text.count(".") + text.count(",")) / len(words), text[-1] in ".!?…", size / len(words) / 8, i / n, (n - i) / n)
    return x


def teach(page_blocks: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray | None:
    """Labels by names of tags; none for a page whose main part isn't named."""
    named = [bool({*path} & {"article", "main"}) for _, path, _ in page_blocks]
    if not any(named):
        return None
    return np.array([m and not ({*path} & ASIDE) for m, (_, path, _) in zip(named, page_blocks, strict=True)], float)


def unnamed(page_blocks: list[tuple[str, tuple[str, ...], float]]) -> list[tuple[str, tuple[str, ...], float]]:
    """The blocks of the same page on a layout that names nothing: classes, ids and roles go, and tags that tell a role are div."""
    return [(text, tuple("div" if n in ROLES else n for n in path if n in PLAIN or n in ROLES), linked) for text, path, linked in page_blocks]


def synthetic(words: list[str], number: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages on varied templates from given words: html, and for each block in order whether it is main text."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def say(low: int, high: int, end: bool = True) -> str:
        out = [pick(words) for _ in range(int(rng.integers(low, high + 1)))]
        return entities.escape(" ".join(out).strip(".,")) + ("." if end else "")

    def attr(*names: str) -> str:
        name = pick(names)
        return pick([f' class="{name}"', f' id="{name}"', f" class='site-{name} x{int(rng.integers(9))}'", f' class="{name}-wrap"'])

    def links(n: int) -> list[str]:
        return [f'<a href="/{k}">{say(1, 2, False)}</a>' for k in range(n)]

    pages = []
    for _ in range(number):
        html, truth = [], []

        def add(tag: str, text: str, main: bool, extra: str = "", html=html, truth=truth) -> None:
            html.append(f"<{tag}{extra}>{text}</{tag}>")
            truth.append(main)

        def menu(html=html, truth=truth) -> None:
            tag = pick(["nav", "div", "ul"])
            items = links(int(rng.integers(3, 9)))
            extra = attr("menu", "nav", "navigation") if tag != "nav" or rng.random() < 0.5 else ""
            if tag == "ul":
                html.append(f"<ul{extra}>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            else:
                html.append(f"<{tag}{extra}><ul>" + "".join(f"<li>{x}</li>" for x in items) + f"</ul></{tag}>")
            truth.extend([False] * len(items))

        def boxed(name_list: tuple[str, ...], tag: str, kind: str, html=html, truth=truth) -> None:
            html.append(f"<{tag}{attr(*name_list) if tag == 'div' or rng.random() < 0.6 else ''}>")
            for _ in range(int(rng.integers(1, 4))):
                add(pick(["p", "div", "h3"] if kind != "form" else ["label", "p"]), say(2, 25), False) if kind != "form" else add("p", say(1, 6), False)
            html.append(f"</{tag}>")

        def advert() -> None:
            add("div", say(2, 20), False, attr("ad", "advert", "sponsored", "promo", "banner"))

        if rng.random() < 0.5:
            html.append(f"<header{attr('header', 'masthead') if rng.random() < 0.5 else ''}>")
            add(pick(["div", "p", "h2"]), say(1, 6, False), False)
            html.append("</header>")
        if rng.random() < 0.9:
            menu()
        if rng.random() < 0.3:
            boxed(("cookie-notice", "notice", "alert", "cookie"), "div", "notice")
        if rng.random() < 0.6:
            advert()
        side = rng.random() < 0.4
        before = side and rng.random() < 0.4
        if before:
            boxed(("sidebar", "side", "related", "widget"), pick(["aside", "div"]), "side")
        tag = pick(["article", "article", "main", "div", "section"])
        html.append(f"<{tag}{attr('content', 'post', 'entry', 'story', 'article') if tag in ('div', 'section') else ''}>")
        if rng.random() < 0.8:
            add(pick(["h1", "h2"]), say(3, 10, False), True)
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.72:
                add("p", say(2, 60) if rng.random() < 0.7 else say(1, 3), True)
            elif kind < 0.78:
                add(pick(["h2", "h3"]), say(1, 6, False), True)
            elif kind < 0.83:
                add("blockquote", say(5, 30), True)
            elif kind < 0.88:
                html.append("<ul>")
                for _ in range(int(rng.integers(2, 5))):
                    add("li", say(2, 12), True)
                html.append("</ul>")
            elif kind < 0.94:
                advert()
            else:
                boxed(("share", "social", "newsletter", "related", "subscribe"), pick(["div", "aside"]), "inside")
        html.append(f"</{tag}>")
        if side and not before:
            boxed(("sidebar", "side", "related", "widget"), pick(["aside", "div"]), "side")
        if rng.random() < 0.4:
            html.append(f"<{pick(['section', 'div'])}{attr('comments', 'comment-list', 'discussion')}>")
            for _ in range(int(rng.integers(1, 6))):
                add(pick(["p", "div"]), say(3, 40), False, attr("comment", "reply") if rng.random() < 0.5 else "")
            html.append("</section></div>")
        if rng.random() < 0.25:
            boxed(("newsletter", "subscribe", "search", "login"), "form", "form")
        if rng.random() < 0.9:
            tag = pick(["footer", "footer", "div"])
            html.append(f"<{tag}{attr('footer', 'copyright') if tag == 'div' else ''}>")
            add(pick(["p", "div"]), "&copy; " + say(2, 20), False)
            html.append(f"</{tag}>")
        pages.append(("<html><head><title>x</title></head><body>" + "".join(html) + "</body></html>", truth))
    return pages


def train(pages: list[str], epochs: int = EPOCHS) -> BiLSTM:
    sequences, labels, words = [], [], []
    for page in pages:
        own = blocks(page)
        y = teach(own) if own else None
        if y is not None:
            sequences += [vectors(own), vectors(unnamed(own))]
            labels += [y, y]
            words += [w for t, _, _ in own for w in t.split(" ")][:200]  # words to put synthetic pages together
    for k, (page, truth) in enumerate(synthetic(words or ["word"], SYNTHETIC)):
        own = blocks(page)
        if len(own) == len(truth):
            sequences.append(vectors(unnamed(own) if k % 2 else own))
            labels.append(np.array(truth, float))
    model = BiLSTM(DIM, HIDDEN)
    model.fit([s.astype(float) for s in sequences], labels, epochs)
    return model


def label(model: BiLSTM, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
    order = [i for i in np.argsort([len(s) for s in sequences], kind="stable").tolist() if len(sequences[i])]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(sequences[order[stop]]) * (stop + 1 - at) <= STEPS_AT_ONCE:
            stop += 1
        x, mask, _ = padded([sequences[i] for i in order[at:stop]], dtype=np.float32)
        found = model.logits(x, mask) > 0
        for r, i in enumerate(order[at:stop]):
            out[i] = found[: len(sequences[i]), r]
        at = stop
    return out


def _extract(model: BiLSTM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [blocks(x) for x in part.column("html").to_pylist()]
                marks = label(model, [vectors(b) if b else np.zeros((0, 1), np.float32) for b in found])
                texts = [" ".join(t for (t, _, _), m in zip(b, mark, strict=True) if m) for b, mark in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    # chosen by key first, so that tasks send keys, and then so many pages at most
    keyed = rows.where(F.length("html") > 0).withColumn("key", F.xxhash64("url", "page_id", "html"))
    some = keyed.select("key").distinct().orderBy("key").limit(SAMPLE)
    sample = keyed.join(F.broadcast(some), "key").groupBy("key").agg(F.first("html").alias("html")).collect()
    model = train([r.html for r in sorted(sample, key=lambda r: r.key)])
    return rows.transform(common.in_arrow, _extract(model), "page_id long, url string, text string, n_chars long")
