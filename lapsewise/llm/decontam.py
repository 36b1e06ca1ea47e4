"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A window is 13 consecutive words of an item; a shorter item is one window. The automaton does not
hold every window: each 13-word window contains one of the item's aligned 7-word blocks, so the
patterns are those blocks (and whole short items), each about once the item's text. A block found
in a document is stretched to both sides as far as document and item agree; runs of 13 words or
more are exactly the places where windows occur. A document is scanned once per automaton, and
word hits map back to character offsets of the original text.

Spark normalises the items and deals them into parts of some PART_BYTES of text (more only where one item is longer).
The parts are taken one after the other: a part is what the driver, a broadcast and a task hold. Up to one part, the
text is scanned exactly once; with more, each pass leaves the places of the documents it hit, which are
merged per document at the end. Blocks that agree along the same shift between item and document are
stretched once, so texts and items that repeat a word over and over stay cheap.

Defined results: null texts have no words; an item without words matches nothing; equal items are
separate items, equal item_ids are one; items without an id mark words but are not listed; a
document without words is never contaminated; rows repeat as they are in the input.
"""

from __future__ import annotations

import re
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.llm.text import alnum_words, with_fields, without
from lapsewise.session import materialise

WINDOW, BLOCK = 13, 7
PART_BYTES = 2 << 20
CONTAMINATED = 20  # hit words x this >= words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_automata: dict[str, tuple] = {}


def normalised(benchmark: DataFrame) -> DataFrame:
    """id (as text), words (with single spaces) of the items that have words."""

    def run(batches):
        for batch in batches:
            words = [b" ".join(alnum_words(t)).decode() for t in batch.column(1).to_pylist()]
            kept = pa.array([bool(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["id", "words"]).filter(kept)

    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "id string, words string")


def parts_of(items: DataFrame) -> int:
    """How many parts the written items make."""
    size = items.agg(F.sum(F.length(F.encode("words", "utf-8")) + 64)).first()[0] or 0
    return max(1, -(-size // PART_BYTES))


def part_of(items: DataFrame, part: int, parts: int) -> list[tuple]:
    """(id, words) of one part; where each goes is settled by a hash of the item."""
    mine = items.filter(F.pmod(F.xxhash64("id", "words"), F.lit(parts)) == part) if parts > 1 else items
    return [(r.id, r.words) for r in mine.distinct().collect()]


def automaton(items: list[tuple]) -> tuple:
    """(automaton from pattern to its places, words per item, id per item); a place is (item, first word)."""
    words, places = [text.split(" ") for _, text in items], {}
    for i, item in enumerate(words):
        starts = range(0, len(item) - BLOCK + 1, BLOCK) if len(item) >= WINDOW else [0]
        for a in starts:
            pattern = item[a : a + BLOCK] if len(item) >= WINDOW else item
            places.setdefault(f" {' '.join(pattern)} ", []).append((i, a))
    found = ahocorasick.Automaton()
    for pattern, where in places.items():
        found.add_word(pattern, (len(pattern), where))
    found.make_automaton()
    return found, words, [i for i, _ in items]


def _agree(a: list[str], i: int, b: list[str], j: int, most: int) -> int:
    """How many words from a[i] and b[j] on are equal, up to `most`; by slices that grow while they agree."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = (step + 1) // 2
            most = min(most, done + 2 * step)
    return done


def scan(text: str, found, items: list[list[str]]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit word ranges (end excluded) and the items, for a text of words with single spaces around them."""
    ranges, hit, words, reached = set(), set(), None, {}
    for end, (length, where) in found.iter(text):
        if words is None:
            words = text.split()
            turned = words[::-1]
            gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        at = int(np.searchsorted(gaps, end - length + 1))
        for i, a in where:
            item = items[i]
            if len(item) < WINDOW:
                ranges.add((at, at + len(item)))
                hit.add(i)
                continue
            # The part of this shift that an earlier block was stretched over is known.
            shift = (i, at - a)
            if reached.get(shift, -1) > at:
                continue
            right = _agree(item, a + BLOCK, words, at + BLOCK, min(len(item) - a, len(words) - at) - BLOCK)
            left = _agree(item[a::-1], 1, turned, len(words) - at, min(a, at)) if a and at else 0
            reached[shift] = at + BLOCK + right
            if left + BLOCK + right >= WINDOW:
                ranges.add((at - left, at + BLOCK + right))
                hit.add(i)
    return sorted(ranges), hit


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of merged word ranges."""
    spans, wanted = [], iter(ranges)
    now, begin = next(wanted, None), 0
    for n, m in enumerate(_WORD.finditer(text)) if now else ():
        if n == now[0]:
            begin = m.start()
        if n == now[1] - 1:
            spans.append((begin, m.end()))
            now = next(wanted, None)
            if now is None:
                break
    return spans


def _held(key: str, items: list[tuple]) -> tuple:
    """The automaton of a part; a worker keeps the last one it built."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(items)
    return _automata[key]


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
FOUND = {
    "n_words": (pa.int64(), "bigint"), "n_hit": (pa.int64(), "bigint"),
    "item_ids": (pa.list_(pa.string()), "array<string>"), "hits": (_SPAN, "array<struct<begin:bigint,end:bigint>>"),
}


def _scanned(text: str | None, found, items, ids) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, hit ranges, and ids of the items of one part in a text."""
    words = alnum_words(text)
    if not words or not items:  # an automaton without patterns cannot be asked
        return len(words), [], []
    ranges, hit = scan(f" {b' '.join(words).decode()} ", found, items)
    return len(words), merged(ranges), sorted({ids[i] for i in hit if ids[i] is not None})


def _arrays(texts: list, rows: list[tuple]) -> list[pa.Array]:
    """The columns of FOUND for (words, ranges, ids) of each text."""
    spans = [[{"begin": b, "end": e} for b, e in char_spans(t, r)] if r else [] for t, (_, r, _) in zip(texts, rows)]
    made = ([n for n, _, _ in rows], [sum(e - b for b, e in r) for _, r, _ in rows], [i for _, _, i in rows], spans)
    return [pa.array(v, kind) for v, (kind, _) in zip(made, FOUND.values())]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with n_words, n_hit (words hit), item_ids and hits (character spans, end excluded)."""
    docs = without(docs, FOUND)
    items = materialise(normalised(benchmark))
    parts = parts_of(items)
    if parts > 1:
        return _find_in_parts(docs, items, parts)
    at, fields = docs.columns.index("text"), docs.columns
    key, sent = str(uuid4()), docs.sparkSession.sparkContext.broadcast(part_of(items, 0, 1))

    def run(batches):
        built = _held(key, sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *_arrays(texts, [_scanned(t, *built) for t in texts])], names=[*fields, *FOUND])

    return docs.mapInArrow(run, with_fields(docs, {n: kind for n, (_, kind) in FOUND.items()}))


def _find_in_parts(docs: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    spark, row = docs.sparkSession, "_decontam_row"
    # Written with a number per row, so that every pass sees the same rows under the same numbers.
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = None
    for part in range(parts):
        key, sent = str(uuid4()), spark.sparkContext.broadcast(part_of(items, part, parts))

        def run(batches, key=key, sent=sent):
            built = _held(key, sent.value)
            for batch in batches:
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    _, ranges, ids = _scanned(text, *built)
                    if ranges:
                        flat = [x for r in ranges for x in r]
                        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([flat], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.string()))], names=[row, "ranges", "ids"])

        some = materialise(rows.select(row, "text").mapInArrow(run, f"{row} bigint, ranges array<bigint>, ids array<string>"))
        hits = some if hits is None else hits.unionByName(some)
        sent.unpersist()
    whole = hits.groupBy(row).agg(F.flatten(F.collect_list("ranges")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("_ids"))
    joined = rows.join(whole, row, "left").select(*docs.columns, "_ranges", "_ids")
    at, fields = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), []
            for text, flat, ids in zip(texts, batch.column(len(fields)).to_pylist(), batch.column(len(fields) + 1).to_pylist()):
                flat = flat or []
                found.append((len(alnum_words(text)), merged(list(zip(flat[::2], flat[1::2]))), sorted(ids or [])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *_arrays(texts, found)], names=[*fields, *FOUND])

    return joined.mapInArrow(run, with_fields(docs, {n: kind for n, (_, kind) in FOUND.items()}))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (CONTAMINATED * F.col("n_hit") >= F.col("n_words"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    # The scan's columns replace clashing ones, so those travel under other names.
    safe = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = find(docs.withColumnsRenamed(safe), benchmark).filter(~contaminated())
    return found.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])
