"""Main text of web pages by a bidirectional LSTM over their text blocks.

A page is cut into leaf blocks at block-level tags. A block is a vector: its tag path (tag names,
words of class and id) hashed into PATH cells, its words hashed into WORDS cells, and a few numbers
(length, link share, marks, place). A bidirectional LSTM in numpy reads a page's blocks in order,
so that every block is classified with the whole page around it; blocks called main text are
joined.

Training needs no labels from outside: on a bounded sample of pages (`train_pages`, chosen by a
hash of page_id, in tables of any size) the page's own markup tells where the article and the frame
around it are. Where the sample names too few articles, all pages are searched for them; pages of
LONG characters or more are taken last, and one at least. Each
sampled page is also trained on in altered form, with containers renamed to other customary names
and with foreign blocks put in as sidebars, notices, forms, adverts and reader comments, so the
model reads names and context rather than one template. Every page is classified by the model.

Defined results: a null page is empty; an empty page, or one without main text, gives an empty
text; scripts, styles, comments and the head hold no text; a head ends at the first tag or text that
cannot stand in it; unclosed tags end with their parent, unclosed comments and scripts with the page,
unclosed styles, titles and text areas at the next tag, other unclosed raw tags where they begin; a line break is white space; rows repeat as in the
input; a quote left open in a tag ends it at the next ">". Where no page of the table names an article, the labeller learns from made pages in
customary markup (`customary_pages`), with a warning. Time and memory grow with a page's length also where
tags nest deeply: a path of more than 2 x ENDS elements is kept as its ends and what names an article or a frame.
"""

from __future__ import annotations

import html as references
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsewise.llm import text as T

TRAIN_PAGES, ALTERED, EPOCHS = 240, 5, 10
# Pages of so many characters are trained on only where shorter ones are too few.
LONG = 200_000
# Blocks of a page that a training step reads: of the page as it is, and of its altered forms.
LONGEST, EXCERPT = 240, 32
PATH, WORDS, NUMBERS, HIDDEN = 512, 16, 8, 16
ENDS = 16  # elements at either end of a path that describe it
BATCH = 96

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template iframe textarea svg".split())
# What may stand in a head; any other tag, and any text, ends it.
_HEAD = frozenset("html base basefont bgsound link meta noframes noscript script style template title".split())
# Raw tags whose content is no text of the page even where no end tag follows: it is skipped up to the next tag.
_UNSAID = frozenset("style title textarea".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Tags whose opening ends an open one of the second set.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_LISTS = frozenset(("ul", "ol", "dl", "table"))
_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(?P<open>[a-zA-Z][^\s/>]*)|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*(?:>|\Z))", re.S,
)
# Behind a page's last ">" no tag can end; these begin markup that the page's end ends.
_CUT_OFF = re.compile(r"<[!?/]")
_SPECIAL = re.compile("[>\"']")
# Comments and scripts are passed over, self-closing svgs have no end tag.
_RAW_TAGS = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<script\b.*?(?:</script\b[^>]*>|\Z)|<svg\b[^>]*/>|<(?P<end>/?)(?P<name>{'|'.join(sorted(_RAW - {'script'}))})(?![^\s/>])[^>]*>",
    re.S | re.I,
)
_SCRIPT_END = re.compile(r"</script\b[^>]*>", re.I)
_NEXT = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")

# What customary markup says about a container; used to label sampled pages and to alter them.
NOISE_TAGS = frozenset("nav footer aside form menu button select option dialog header".split())
NOISE_NAMES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies notice consent gdpr popup modal menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar side widget footer header masthead comment comments commentlist reply replies "
    "disqus share social related newsletter subscribe login search copyright alert".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content post entry story main".split())

_MARK = np.isin(np.arange(256), [ord(c) for c in ".,!?;"])

Block = tuple[tuple[str, ...], str, int]


@lru_cache(maxsize=65536)
def _element(name: str, rest: str) -> str:
    """A path element: tag name and the words of class, id and role."""
    words = [w for m in _NAMES.finditer(rest) for w in _PARTS.findall(next(g for g in m.groups() if g is not None).lower())]
    return " ".join([name, *words])


def _raw_ends(page: str) -> dict[int, int]:
    """From where a raw tag (no script) begins to where its own end tag ends; raw tags without one are left out."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for tag in _RAW_TAGS.finditer(page, 0, page.rfind(">") + 1):
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if not tag["end"]:
            opened.setdefault(name, []).append(tag.start())
        elif opened.get(name):
            ends[opened[name].pop()] = tag.end()
    return ends


def _tag_end(page: str, at: int, lost: set[int]) -> int:
    """The ">" that ends a tag outside quotes, -1 when a quote stays open; `lost` remembers quotes that lead there."""
    seen = []
    while special := _SPECIAL.search(page, at):
        begin = special.start()
        if page[begin] == ">":
            return begin
        seen.append(begin)
        end = -1 if begin in lost else page.find(page[begin], begin + 1)
        if end < 0:
            break
        at = end + 1
    lost.update(seen)
    return -1


class _Open:
    """The open tags, with how many of each name there are, and the block-level ones among them as a path."""

    def __init__(self):
        self.stack: list[str] = []
        self.held: Counter = Counter()
        self._below: list[int] = []  # block-level elements below each open tag
        self._levels: list[str] = []
        self._notable: list[tuple[tuple[int, int], ...]] = []  # per level: kind and place of the first article and frame

    def push(self, name: str, rest: str) -> None:
        self._below.append(len(self._levels))
        self.stack.append(name)
        self.held[name] += 1
        if name in _BLOCK:
            element, known = _element(name, rest), self._notable[-1] if self._notable else ()
            kind = _kind(element)
            if kind and all(k != kind for k, _ in known) and not (kind < 0 and name == "header" and any(k > 0 for k, _ in known)):
                known = (*known, (kind, len(self._levels)))
            self._levels.append(element)
            self._notable.append(known)

    def cut(self, depth: int | None) -> None:
        if depth is not None:
            self.held.subtract(self.stack[depth:])
            del self._levels[self._below[depth] :], self._notable[self._below[depth] :]
            del self.stack[depth:], self._below[depth:]

    def end(self, name: str) -> None:
        """End the innermost open tag of a name, and what is open inside it."""
        if self.held[name] > 0:
            self.cut(_last(self.stack, {name}))

    def path(self) -> tuple[str, ...]:
        """The block-level elements; of more than twice ENDS the outer and inner ENDS, and what says article or frame between."""
        levels = self._levels
        if len(levels) <= 2 * ENDS:
            return tuple(levels)
        between = (levels[i] for _, i in self._notable[-1] if ENDS <= i < len(levels) - ENDS)
        return (*levels[:ENDS], *between, *levels[-ENDS:])


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: (path, text, characters inside links)."""
    page = page or ""
    tags, held = (open_ := _Open()).stack, open_.held
    out: list[Block] = []
    pieces: list[str] = []
    linked, at, path = 0, 0, ()
    raw_ends: dict[int, int] | None = None
    last, lost = page.rfind(">"), set()

    def flush():
        nonlocal pieces, linked
        if pieces:
            joined = "".join(pieces)
            words = (references.unescape(joined) if "&" in joined else joined).split()
            if words:
                out.append((path, " ".join(words), linked))
            pieces, linked = [], 0

    def say(words: str):
        nonlocal path, linked
        if words and held["head"] and not words.isspace():
            open_.end("head")
        if words and not held["head"]:
            if not pieces:
                path = open_.path()
            pieces.append(words)
            linked += len(words) if held["a"] else 0

    while True:
        tag = _TAG.search(page, at)
        if not tag or tag.start() > last:
            cut_off = _CUT_OFF.search(page, at)
            say(page[at : cut_off.start()] if cut_off else page[at:])
            break
        say(page[at : tag.start()])
        at, rest = tag.end(), ""
        name = (tag["open"] or "").lower()
        closing = (tag["close"] or "").lower()
        if name:
            end = _tag_end(page, at, lost)
            # With a quote left open, a tag ends at the next ">" and has no names.
            at, rest = (page.find(">", at) + 1, "") if end < 0 else (end + 1, page[at:end])
        if name and name not in _HEAD:
            open_.end("head")
        if name == "script":
            end = _SCRIPT_END.search(page, at)
            at = end.end() if end else len(page)
        elif name == "svg" and rest.endswith("/"):
            pass
        elif name in _RAW:
            raw_ends = _raw_ends(page) if raw_ends is None else raw_ends
            end = raw_ends.get(tag.start())
            if end is None and name in _UNSAID:
                end = following.start() if (following := _NEXT.search(page, at)) else len(page)
            # Without an end tag, what follows the others belongs to the page.
            at = max(at, end or 0)
        elif name:
            if name in _BLOCK:
                flush()
                open_.end("p")
                ended = _ENDS.get(name, ())
                if any(held[e] > 0 for e in ended):
                    # Only within the same list, table or body.
                    depth = _last(tags, _LISTS.union(ended))
                    if tags[depth] in ended:
                        open_.cut(depth)
            elif name == "br":
                say(" ")
            if name not in _VOID and not rest.endswith("/"):
                open_.push(name, rest)
        elif closing:
            if closing in _BLOCK:
                flush()
            open_.end(closing)
    flush()
    return out


def _last(stack: Sequence[str], names) -> int | None:
    return next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in names), None)


def _kind(element: str) -> int:
    """-1 for a container that customary markup uses for the frame, 1 for the article, else 0."""
    tag, *names = element.split(" ")
    if tag in NOISE_TAGS or NOISE_NAMES & set(names):
        return -1
    return int(tag in MAIN_TAGS or bool(MAIN_NAMES & set(names)))


def marked(blocks: list[Block]) -> list[int] | None:
    """1 for blocks that the markup puts into the article; None if it names no article."""
    kinds = [[_kind(e) for e in path] for path, _, _ in blocks]
    if not any(1 in k for k in kinds):
        return None
    # A header inside an article belongs to it, any other frame inside it does not.
    return [
        int(1 in k and all(v >= 0 or (e.split(" ")[0] == "header" and 1 in k[:i]) for i, (v, e) in enumerate(zip(k, path))))
        for k, (path, _, _) in zip(kinds, blocks)
    ]


_OTHER_MAIN = ("article", "main", "div content", "div post", "div entry content", "section article", "div main content", "div story", "article post", "div article body")
_OTHER_FRAME = {
    "nav": ("nav", "div menu", "div navbar", "ul nav", "header", "div header", "nav breadcrumb", "menu"),
    "footer": ("footer", "div footer", "div site footer", "section footer", "div copyright"),
    "ad": ("div ad", "div advert", "div sponsored", "aside ad", "div banner", "div ads", "section promo", "div advertisement"),
}
_INNER = (
    ("p",), ("div",), ("div", "p"), ("section", "p"), ("section", "h2"), ("h2",), ("h3",), ("header", "h1"), ("header", "p"), ("ul", "li"), ("ol", "li"),
    ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("table", "tr", "th"), ("pre",), ("dl", "dd"),
    ("figure", "figcaption"), (),
)
_INSERTED = (
    ("aside",), ("aside sidebar", "p"), ("div sidebar", "p"), ("div widget", "ul", "li"), ("aside", "div related", "ul", "li"), ("div cookie notice", "p"),
    ("div notice",), ("div alert",), ("div consent banner", "p"), ("form", "p"), ("form", "div"), ("form login", "label"), ("form search", "button"), ("div newsletter", "form", "p"),
    ("div comments", "div comment", "p"), ("section comments", "article comment", "p"), ("ol commentlist", "li comment", "p"), ("div comments", "p"),
    ("section comments", "div comment"), ("div share",), ("header", "p"), ("div header",), ("div ad",), ("div social", "ul", "li"), ("div popup", "p"), ("footer", "p"),
)


def altered(blocks: list[Block], labels: list[int], random: np.random.Generator, foreign: list[str]) -> tuple[list[Block], list[int]]:
    """The page with renamed containers and foreign blocks put in."""
    pick = lambda options: options[random.integers(len(options))]
    main = pick(_OTHER_MAIN)
    frames = {k: pick(v) for k, v in _OTHER_FRAME.items()}

    def renamed(path):
        out = []
        for e in path:
            tag, *names = e.split(" ")
            if _kind(e) > 0:
                out.append(main)
            elif _kind(e) < 0:
                out.append(frames.get("ad" if {"ad", "ads", "advert"} & set(names) else tag, e))
            else:
                out.append(e)
        return tuple(out)

    def inner(path):
        at = next((i + 1 for i, e in enumerate(path) if _kind(e) > 0), None)
        return path if at is None or random.random() > often else path[:at] + pick(_INNER)

    often = pick((0.0, 0.2, 0.6))
    pages = [((inner(renamed(p)) if y else renamed(p), t, n), y) for (p, t, n), y in zip(blocks, labels)]
    article = next((p for (p, _, _), y in pages if y), ("html", "body"))
    inside = article[: next((i + 1 for i, e in enumerate(article) if _kind(e) > 0), len(article))]
    for _ in range(random.integers(0, 5)):
        extra = pick(_INSERTED)
        # Frames stand in the article as well as around it.
        own = [i for i, (_, y) in enumerate(pages) if y]
        within = own and random.random() < 0.5
        base = inside if within else ("html", "body")
        at = random.integers(own[0], own[-1] + 2) if within else random.integers(0, len(pages) + 1)
        run = [((base + extra, pick(foreign), 0), 0) for _ in range(random.integers(1, 4))]
        pages[at:at] = run
    return [b for b, _ in pages], [y for _, y in pages]


@lru_cache(maxsize=65536)
def _cells(element: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(part.encode()) % PATH for part in element.split(" "))


@lru_cache(maxsize=65536)
def _path_cells(path: tuple[str, ...]) -> tuple[int, ...]:
    ends = path if len(path) <= 2 * ENDS else path[:ENDS] + path[-ENDS:]
    inner = zlib.crc32(("in " + ends[-1]).encode()) % PATH if ends else 0
    return tuple(sorted({c for e in ends for c in _cells(e)} | {inner}))


def vectors(blocks: list[Block]) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """The blocks' paths, and their word cells and numbers."""
    texts = [t.encode("utf-8", "replace") for _, t, _ in blocks]
    data = b" ".join(texts)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    first, last = T.word_spans(data)
    sums = T.prefix_sums(data)
    owner = np.searchsorted(begins, first, side="right") - 1
    hashes = T.span_hash(sums, first, last)
    cell = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    words = np.bincount(owner, minlength=len(blocks)).astype(float)
    bag = np.bincount(owner * WORDS + cell, weights=sign, minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    bag = bag / np.sqrt(np.maximum(words, 1))[:, None]
    codes = np.frombuffer(data, np.uint8)
    marks = np.concatenate(([0], np.cumsum(_MARK[codes])))
    ends = begins + sizes
    place = np.arange(len(blocks)) / max(len(blocks) - 1, 1)
    numbers = np.stack([
        np.log1p(words) / 5, np.array([n for _, _, n in blocks]) / np.maximum(sizes, 1), (marks[ends] - marks[begins]) / np.maximum(words, 1),
        place, 1 - place, np.full(len(blocks), np.log1p(len(blocks)) / 5), (words < 4) * 1.0, np.ones(len(blocks)),
    ], axis=1)
    return [p for p, _, _ in blocks], np.concatenate((bag, numbers), axis=1).astype(np.float32)


@dataclass
class Batch:
    """Pages side by side, padded to the longest: distinct paths, each block's path, the other inputs, the mask."""

    paths: np.ndarray
    path: np.ndarray
    other: np.ndarray
    mask: np.ndarray

    @classmethod
    def of(cls, pages: list[tuple[list, np.ndarray]]) -> "Batch":
        known: dict[tuple, int] = {}
        longest = max(len(p) for p, _ in pages)
        path = np.zeros((len(pages), longest), np.int64)
        other = np.zeros((len(pages), longest, WORDS + NUMBERS), np.float32)
        mask = np.zeros((len(pages), longest), np.float32)
        for i, (paths, rest) in enumerate(pages):
            path[i, : len(paths)] = [known.setdefault(p, len(known)) for p in paths]
            other[i, : len(paths)] = rest
            mask[i, : len(paths)] = 1
        table = np.zeros((max(len(known), 1), PATH), np.float32)
        for p, i in known.items():
            table[i, list(_path_cells(p))] = 1
        return cls(table, path, other, mask)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The bidirectional LSTM: weights per direction, and one output unit on both states."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, random: np.random.Generator) -> "Labeller":
        w = {"out": random.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            w[d + "path"] = random.normal(0, 0.1, (PATH, 4 * HIDDEN))
            w[d + "other"] = random.normal(0, 0.1, (WORDS + NUMBERS, 4 * HIDDEN))
            w[d + "state"] = random.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            gate = np.zeros(4 * HIDDEN)
            gate[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            w[d + "gate"] = gate
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, b: Batch, d: str, keep: bool):
        w = self.weights
        given = (b.paths @ w[d + "path"])[b.path] + b.other @ w[d + "other"] + w[d + "gate"]
        pages, steps = b.mask.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        states = np.zeros((pages, steps, HIDDEN), np.float32)
        trace = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ w[d + "state"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = b.mask[:, t : t + 1]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            if keep:
                trace[t] = (i, f, o, g, squashed, c, h, m)
            c, h = m * fresh + (1 - m) * c, m * o * squashed + (1 - m) * h
            states[:, t] = h
        return states, trace

    def chances(self, b: Batch) -> np.ndarray:
        both = np.concatenate((self._run(b, "f", False)[0], self._run(b, "b", False)[0]), axis=2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"])

    def gradients(self, b: Batch, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks and its gradients."""
        w = self.weights
        runs = {d: self._run(b, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid(both @ w["out"] + w["bias"])
        count = b.mask.sum()
        loss = -float((b.mask * np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / count)
        error = b.mask * (p - labels) / count
        grads = {"out": np.einsum("pt,pth->h", error, both), "bias": np.array([error.sum()])}
        for n, d in enumerate("fb"):
            back = error[:, :, None] * w["out"][n * HIDDEN : (n + 1) * HIDDEN]
            grads |= self._back(b, d, runs[d][1], back)
        return loss, grads

    def _back(self, b: Batch, d: str, trace: list, back: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        pages, steps = b.mask.shape
        dz = np.zeros((pages, steps, 4 * HIDDEN), np.float32)
        dstate = np.zeros_like(w[d + "state"])
        dh = np.zeros((pages, HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, g, squashed, c, h, m = trace[t]
            dh = dh + back[:, t]
            dfresh = m * (dc + dh * o * (1 - squashed**2))
            z = dz[:, t]
            z[:, :HIDDEN] = dfresh * g * i * (1 - i)
            z[:, HIDDEN : 2 * HIDDEN] = dfresh * c * f * (1 - f)
            z[:, 2 * HIDDEN : 3 * HIDDEN] = m * dh * squashed * o * (1 - o)
            z[:, 3 * HIDDEN :] = dfresh * i * (1 - g**2)
            dstate += h.T @ z
            dh, dc = (1 - m) * dh + z @ w[d + "state"].T, (1 - m) * dc + dfresh * f
        by_path = np.zeros((len(b.paths), 4 * HIDDEN), np.float32)
        np.add.at(by_path, b.path.ravel(), dz.reshape(-1, 4 * HIDDEN))
        return {
            d + "path": b.paths.T @ by_path, d + "other": np.einsum("pti,ptj->ij", b.other, dz),
            d + "state": dstate, d + "gate": dz.sum(axis=(0, 1)),
        }


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 3) -> Labeller:
    """Adam over the pages and their altered forms, pages of like length together."""
    random = np.random.default_rng(seed)
    model = Labeller.fresh(random)
    foreign = [t for blocks, _ in pages for _, t, _ in blocks]
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        forms = []
        for blocks, labels in pages:
            for most, times in ((LONGEST, 1), (EXCERPT, ALTERED)):
                for _ in range(times):
                    begin = random.integers(0, max(1, len(blocks) - most + 1))
                    part = blocks[begin : begin + most], labels[begin : begin + most]
                    forms.append(part if most == LONGEST else altered(*part, random, foreign))
        forms.sort(key=lambda f: len(f[0]) + random.random())
        groups = [forms[i : i + 48] for i in range(0, len(forms), 48)]
        for n in random.permutation(len(groups)):
            batch = Batch.of([vectors(blocks) for blocks, _ in groups[n]])
            marks = np.zeros(batch.mask.shape, np.float32)
            for i, (_, labels) in enumerate(groups[n]):
                marks[i, : len(labels)] = labels
            _, grads = model.gradients(batch, marks)
            step += 1
            rate = 0.015 * (1 - epoch / epochs) + 0.0005
            for k, grad in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad**2
                change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                model.weights[k] = (model.weights[k] - rate * change).astype(np.float32)
    return model


def sample(pages: DataFrame, most: int) -> list[tuple[list[Block], list[int]]]:
    """At most `most` pages whose markup names an article, with their labels; none only where no page of the table does."""
    share = 1.5 * most / max(pages.count(), 1)
    found: list[str] = []
    if share < 1:
        # The whole 64-bit hash is compared: no table is too large for its share.
        found = _known(pages.filter(F.xxhash64("page_id") < int(share * 2**64) - 2**63), most)
    if len(found) < most // 8:
        found = _known(pages, most)
    parsed = [blocks_of(h) for h in found]
    return [(blocks, marked(blocks)) for blocks in parsed]


def _known(pages: DataFrame, most: int) -> list[str]:
    """The pages that name an article, least hash first; long ones only where others are too few, up to `most` x LONG characters."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named = [i for i, t in enumerate(texts) if (blocks := blocks_of(t)) and marked(blocks)]
            kept = batch.column(0).take(pa.array(named, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array([len(texts[i]) for i in named], pa.int64())], names=["key", "size"])

    keyed = pages.select(F.xxhash64("page_id", "html").alias("key"), "html")
    keys, total = [], 0
    for row in keyed.mapInArrow(run, "key bigint, size bigint").distinct().orderBy(F.col("size") >= LONG, "key").limit(most).collect():
        if keys and total + row.size > most * LONG:
            break
        keys.append(row.key)
        total += row.size
    if not keys:
        return []
    rows = keyed.filter(F.col("key").isin(keys)).groupBy("key").agg(F.first("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: r.key)]


_BARE = (("html", "body", "p"), ("html", "body", "div", "p"), ("p",), ("html", "body", "div"), ("html", "body", "h1"))
_FRAMES = (
    ("nav", "ul", "li"), ("header",), ("header", "nav", "a"), ("aside",), ("aside sidebar", "p"), ("footer",), ("footer", "p"), ("div cookie notice", "p"), ("div ad",),
    ("form", "label"), ("div comments", "div comment", "p"), ("div menu", "ul", "li"), ("div footer",), ("div share",), ("div related", "ul", "li"),
)
_SHORT = "Home; About us; Contact; Sign in; Subscribe; Share this; Privacy; Terms of use; All rights reserved; Read more; We use cookies; Sponsored; Your name; Next; Menu; Search".split("; ")
_SAID = "the a new old report says that many people in this city have found after years of work how water light and time can change what they know about their own town".split()


def customary_pages(many: int = 90, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Made pages in customary markup: articles in and outside named containers, with frames before, between and behind."""
    random = np.random.default_rng(seed)
    pick = lambda options: options[random.integers(len(options))]

    def said() -> str:
        words = [pick(_SAID) for _ in range(random.integers(4, 14))]
        return f"{' '.join(words).capitalize()}{pick(('.', '.', '?', ', and more.'))}"

    def frame() -> list[Block]:
        path = ("html", "body", *pick(_FRAMES))
        texts = [pick(_SHORT) if random.random() < 0.7 else said() for _ in range(random.integers(1, 5))]
        return [(path, t, len(t) if random.random() < 0.5 else 0) for t in texts]

    pages = []
    for n in range(many):
        if n % 6 == 0:  # nothing but a bare text
            path, texts = pick(_BARE), [pick(_SAID) if n % 4 else said() for _ in range(1 + n // 12 % 3)]
            pages.append(([(path, t, 0) for t in texts], [1] * len(texts)))
            continue
        inside = ("html", "body", pick(_OTHER_MAIN)) if n % 3 else pick(_BARE)[:-1]
        body = [(*inside, *pick(_INNER[:8])) if n % 3 else (*inside, pick(("p", "p", "h2", "div"))) for _ in range(random.integers(2, 12))]
        parts = [(b, 0) for _ in range(random.integers(0, 3)) for b in frame()]
        parts += [((path, " ".join(said() for _ in range(random.integers(1, 5))), 0), 1) for path in body]
        parts += [(b, 0) for _ in range(random.integers(0, 4)) for b in frame()]
        pages.append(([b for b, _ in parts], [y for _, y in parts]))
    return pages


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Labeller:
    known = sample(pages.select("page_id", "html"), train_pages)
    if not known:
        warnings.warn("No page names an article: the labeller is trained on made pages in customary markup.", stacklevel=2)
    return fit(known or customary_pages())


def label(pages: list[list[Block]], model: Labeller) -> list[list[bool]]:
    """Which blocks are main text, for many pages; pages of like length share a batch."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # A batch holds BATCH pages, fewer when they are long.
        width = max(1, min(BATCH, 20_000 // len(pages[order[min(at + BATCH, len(order)) - 1]])))
        mine = order[at : at + width]
        chances = model.chances(Batch.of([vectors(pages[i]) for i in mine]))
        for i, row in zip(mine, chances):
            out[i] = list(row[: len(pages[i])] >= 0.5)
        at += width
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                blocks = [blocks_of(h.as_py()) for h in part.column(2)]
                kept = label(blocks, sent.value)
                texts = ["\n".join(t for (_, t, _), k in zip(b, ks) if k) for b, ks in zip(blocks, kept)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = pages.select("page_id", "url")
    return pages.select("page_id", "url", "html").mapInArrow(run, T.with_fields(kinds, {"text": "string", "n_chars": "bigint"}))


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages))
