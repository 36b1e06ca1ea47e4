"""Word rules and numpy text hashing shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words are what stands between white space (ASCII) ...
SPACED = r"[^\x20\x09-\x0D]+"
# ... or runs of lower-case letters, digits and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, lone surrogates become '?'."""
    return (text or "").encode("utf-8", "replace")


def lowered(text: str | None) -> bytes:
    return utf8(text).translate(_LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """The ALNUM words of a text after lower-casing A-Z."""
    return utf8(text).translate(_ALNUM).split()  # only spaces are left as white space


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        base = np.uint64(_BASE if way == "up" else _BASE_INVERSE)
        powers = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        powers[0] = 1
        _powers[way] = np.cumprod(powers)
    return _powers[way][:n]


def prefix_sums(data: bytes) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; `span_hash` reads the hash of any span from them."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[np.frombuffer(data, np.uint8)]
    np.cumsum(codes * _power("up", len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * _power("down", len(sums))[begin] + (end - begin).astype(np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end offsets of the white-space separated words."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    begin, end = word_spans(data)
    return span_hash(prefix_sums(data), begin, end)


def joined_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts in one pass, and each text's first word among them (one more for the end)."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = b" ".join(texts)
    begin, end = word_spans(data)
    return span_hash(prefix_sums(data), begin, end), np.searchsorted(begin, starts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A cheaper hash for every run of n words, none when there are fewer: a filter ahead of an exact step."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * _power("up", len(words)))))
    return mix((sums[n:] - sums[:-n]) * _power("down", len(words))[: len(words) - n + 1])


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n words; the whole sequence when there are fewer, nothing for no words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(31) + words[i : len(words) - n + 1 + i] + np.uint64(n))
    return total


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no classifier learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def chosen(key: Column, share: float) -> Column:
    """True for about a share of all 64-bit hashes, however small the share."""
    # Of 2**64 hashes the lowest share; the decimal holds every bound exactly.
    bound = -(1 << 63) + int(min(1.0, max(0.0, share)) * (1 << 64))
    return key.cast("decimal(20,0)") < F.lit(str(bound)).cast("decimal(20,0)")


def learnable(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of about `most` labelled documents, chosen by a hash of doc_id, small enough to be broadcast.

    Held-out documents are no part of it; one with several labels has the largest.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(known.count(), 1))
    return F.broadcast(known.filter(chosen(F.xxhash64("doc_id"), share)))


def frequent_bound(counts: DataFrame, column: str, most: int) -> int:
    """The least bound, of some 64 for every doubling, that at most `most` rows of positive counts reach."""
    n = F.col(column)
    drop = F.greatest(F.lit(0), F.floor(F.log2(n)).cast("int") - 6)
    steps = counts.groupBy((F.floor(n / F.pow(F.lit(2.0), drop)) * F.pow(F.lit(2.0), drop)).cast("bigint").alias("step")).count()
    rows = sorted(steps.collect(), reverse=True)  # at most 64 x 63 rows
    bound, held = (rows[0].step + 1 if rows else 1), 0
    for i, r in enumerate(rows):
        held += r["count"]
        if held > most:
            break
        bound = r.step
    # A row may lie above its step's start; one above the last step holds them all.
    return bound if held <= most or bound <= rows[0].step else 1 << 62


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose names an operator's output takes."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_fields(df: DataFrame, fields: Mapping[str, str]) -> T.StructType:
    """The schema of a table with further columns, given as SQL types."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields.items())).fields)


def slices(values: Iterable, most: int, weight=len) -> Iterator[list]:
    """Cut a stream into lists whose summed weight stays near `most`."""
    part, total = [], 0
    for value in values:
        part.append(value)
        total += weight(value)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def sliced(batches, rows: int = 512):
    """The same rows in small batches, so that a worker holds few texts at once as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
