"""Alignment of two tokenizers' tokens by their bytes, each distinct text once.

Texts are shuffled by their full text and counted; each distinct text is tokenised once by A
(byte-level BPE) and B (pieces with byte fallback), and its ids are written. Tokens are placed by the
bytes they stand for; where both tokenizers end a token a group ends, and tokens whose bytes overlap
are linked. A pair of ids counts as many documents as hold it linked: every distinct text adds its number
of copies. Tasks sum the pairs before they are shuffled. The measures that need these
counts look up at most TABLE pairs, the most frequent ones, in a broadcast table, and join the rest of
the links by pair, so nothing is left out; then the measures join the documents by the text's SHA-256. Texts with more than
a thousandth of all rows (at most a thousand) are joined by broadcast, as they would crowd one task.

Defined results: null and empty texts, and texts whose tokens' bytes are not the text's with a space before it (B may
normalise), have no tokens: zeros and an empty digest; special tokens' strings in texts are plain text; rows repeat
as in the input; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsewise.llm import text as T
from lapsewise.session import materialise

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies cut a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pairs in the broadcast table (12 bytes each); pairs a task holds before it hands them on; bytes of text at a time.
TABLE, HELD, SLICE_BYTES = 1 << 20, 1 << 21, 1 << 20
# A text with more than this share of the rows is joined by broadcast.
HOT_SHARE = 1e-3
_ID_BITS = 16
_SEPARATORS = ("", ",", "|", ";")


class Tokenizers(NamedTuple):
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_length: np.ndarray
    b_length: np.ndarray
    decimal: list[str]  # of every id, behind each separator


_loaded: dict[str, Tokenizers] = {}


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(folder: str) -> Tokenizers:
    """Both tokenizers, once a worker."""
    if folder not in _loaded:
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(os.path.join(folder, A_FILE), encoding="utf-8") as file:
            known = json.load(file)
        special = {t["id"] for t in known.get("added_tokens", [])}
        vocabulary = {t: i for t, i in known["model"]["vocab"].items() if i not in special}
        b = SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        sign, a_bytes = _byte_of_sign(), [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(sign[c] for c in token)
        # Its ids are in the order of its merges, so they serve as ranks; no special tokens, so their strings are plain text.
        ranks = {t: i for i, t in enumerate(a_bytes) if t}
        a = Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        b_bytes = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if max(len(a_bytes), len(b_bytes)) > 1 << _ID_BITS:
            raise ValueError("vocabularies of more than 65,536 tokens need wider ids")
        decimal = [s + str(i) for s in _SEPARATORS for i in range(1 << _ID_BITS)]
        _loaded[folder] = Tokenizers(a, b, a_bytes, b_bytes, *(np.array([len(x) for x in v]) for v in (a_bytes, b_bytes)), decimal)
    return _loaded[folder]


def encode(texts: list[str], both: Tokenizers) -> list[tuple[list[int], list[int]]]:
    """Ids of each text by A and B; none where the bytes are not the text's."""
    out = []
    for text, b in zip(texts, both.b.encode(texts, num_threads=1)):
        a, want = both.a.encode_ordinary(" " + text), b" " + T.utf8(text)
        same = text and b"".join([both.a_bytes[i] for i in a]) == want and b"".join([both.b_bytes[i] for i in b]) == want
        out.append((a, b) if same else ([], []))
    return out


class Placed(NamedTuple):
    """Tokens of several texts in a row; per A token the B tokens it overlaps, per token its group."""

    first: np.ndarray
    last: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_closes: np.ndarray  # a group ends with this A token


def place(a: np.ndarray, b: np.ndarray, both: Tokenizers) -> Placed:
    a_length, b_length = both.a_length[a], both.b_length[b]
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    at_byte = np.repeat(np.arange(len(b), dtype=np.int32), b_length)
    a_closes, b_closes = (np.zeros(len(at_byte), bool) for _ in range(2))
    a_closes[a_end - 1] = True
    b_closes[b_end - 1] = True
    closes = a_closes & b_closes
    a_closes, b_closes = closes[a_end - 1], closes[b_end - 1]
    return Placed(
        at_byte[a_end - a_length], at_byte[a_end - 1], np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes, a_closes,
    )


def links(a: np.ndarray, b: np.ndarray, placed: Placed) -> tuple[np.ndarray, np.ndarray]:
    """The A token's number and the pair code of every link."""
    many = placed.last - placed.first + 1
    token = np.repeat(np.arange(len(a)), many)
    other = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + placed.first[token]
    return token, a[token].astype(np.uint32) << np.uint32(_ID_BITS) | b[other].astype(np.uint32)


def group_lines(a: np.ndarray, b: np.ndarray, placed: Placed, a_starts: np.ndarray, b_starts: np.ndarray, decimal: list[str]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text."""
    groups = int(placed.a_closes.sum())
    a_many, b_many = (np.bincount(g, minlength=groups) for g in (placed.a_group, placed.b_group))
    a_at = np.arange(len(a)) + (np.cumsum(b_many) - b_many)[placed.a_group]
    b_at = np.arange(len(b)) + np.cumsum(a_many)[placed.b_group]
    opens = lambda g: np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.empty(0, bool)
    a_sign = np.where(opens(placed.a_group), 3, 1)
    a_sign[a_starts[:-1][a_starts[1:] > a_starts[:-1]]] = 0
    codes = np.empty(len(a) + len(b), np.int64)
    codes[a_at] = a_sign << _ID_BITS | a
    codes[b_at] = np.where(opens(placed.b_group), 2, 1) << _ID_BITS | b
    ends = a_starts + b_starts
    return ["".join([decimal[c] for c in codes[i:j].tolist()]) for i, j in zip(ends[:-1], ends[1:])]


def _starts(lists: list) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)


def _row(lists: list) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)


def encoded(docs: DataFrame, folder: str = FOLDER, digest: bool = True) -> DataFrame:
    """One row per distinct text that both tokenizers cover: key, copies, a and b (16-bit ids), n_groups, n_links, groups.

    The groups are several times as long as the text; with `digest` their SHA-256 stands for them.
    """

    def run(batches):
        both = load(folder)
        for batch in batches:
            begin, texts = 0, batch.column(2)
            for part in T.slices((t.as_py() for t in texts), SLICE_BYTES):
                ids = encode(part, both)
                a_starts, b_starts = _starts([x for x, _ in ids]), _starts([x for _, x in ids])
                a, b = _row([x for x, _ in ids]), _row([x for _, x in ids])
                placed = place(a, b, both)
                upto = lambda v, at: np.concatenate(([0], np.cumsum(v)))[at]
                lines = group_lines(a, b, placed, a_starts, b_starts, both.decimal)
                lines = [hashlib.sha256(x.encode()).hexdigest() for x in lines] if digest else lines
                keep = np.diff(a_starts) > 0
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(begin, len(part)) for c in batch.columns[:2]],
                    *[pa.array([np.array(x[i], np.uint16).tobytes() for x in ids], pa.binary()) for i in (0, 1)],
                    pa.array(np.diff(upto(placed.a_closes, a_starts))), pa.array(np.diff(upto(placed.last - placed.first + 1, a_starts))),
                    pa.array(lines, pa.string()),
                ], names=["key", "copies", "a", "b", "n_groups", "n_links", "groups"]).filter(pa.array(keep))
                begin += len(part)

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = texts.select(text_key("text"), "copies", "text")
    return keyed.mapInArrow(run, "key binary, copies bigint, a binary, b binary, n_groups bigint, n_links bigint, groups string")


def text_key(column: str):
    return F.unhex(F.sha2(column, 256)).alias("key")


def _read(batch, size: int = SLICE_BYTES):
    """Slices of a batch of (..., a, b): begin, ids in a row with the texts' starts."""
    begin = 0
    sides = [[np.frombuffer(v.as_py(), np.uint16) for v in batch.column(batch.schema.get_field_index(n))] for n in ("a", "b")]
    for part in T.slices(zip(*sides), size, lambda x: 4 * len(x[0])):
        yield begin, _row([x for x, _ in part]), _row([x for _, x in part]), _starts([x for x, _ in part]), len(part)
        begin += len(part)


def pair_counts(texts: DataFrame, folder: str = FOLDER) -> DataFrame:
    """pair (A id << 16 | B id), n: documents that hold it linked."""

    def summed(parts):
        pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in parts]))
        return pair, n

    def run(batches):
        both, held, size = load(folder), [], 0
        for batch in batches:
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            for begin, a, b, starts, many in _read(batch):
                token, pair = links(a, b, place(a, b, both))
                text = np.repeat(np.arange(many, dtype=np.uint64), np.diff(starts))[token]
                seen = np.unique(text << np.uint64(32) | pair)  # a document counts once, however many links it holds
                held.append(((seen & np.uint64(0xFFFFFFFF)).astype(np.int64), copies[begin + (seen >> np.uint64(32)).astype(np.int64)]))
                size += len(seen)
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], names=["pair", "n"])

    return texts.select("copies", "a", "b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def measured(texts: DataFrame, counts: DataFrame, folder: str = FOLDER, table: int = TABLE) -> DataFrame:
    """The distinct texts with n_best and count_sum."""
    context = texts.sparkSession.sparkContext
    bound = T.frequent_bound(counts, "n", table)
    often = counts.filter(F.col("n") >= bound).select("pair", "n").toArrow()
    order = np.argsort(pairs := often.column("pair").to_numpy())
    best = counts.groupBy(F.shiftright("pair", _ID_BITS).cast("int").alias("a")).agg(F.max("n").alias("best"))
    highest = np.zeros(1 << _ID_BITS, np.int64)
    for r in best.collect():  # at most a row for each id of A
        highest[r.a] = r.best
    sent = context.broadcast((pairs[order], often.column("n").to_numpy()[order], highest))

    def run(batches):
        both, (known, n, highest) = load(folder), sent.value
        for batch in batches:
            for begin, a, b, starts, many in _read(batch):
                token, pair = links(a, b, place(a, b, both))
                pair = pair.astype(np.int64)
                text = np.repeat(np.arange(many), np.diff(starts))[token]
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                value = np.where(hit, n[at], 0) if len(known) else np.zeros(len(pair), np.int64)
                is_best = hit & (value == highest[a[token]])
                # Sums over a text as differences of running sums: exact in 64-bit integers.
                ends = np.searchsorted(text, np.arange(many + 1))
                total = np.concatenate(([0], np.cumsum(value)))[ends]
                bests = np.concatenate(([0], np.cumsum(is_best)))[ends]
                rest_text, rest_pair = text[~hit], pair[~hit]
                rest_ends = np.searchsorted(rest_text, np.arange(many + 1))
                rest = [np.unique(rest_pair[i:j], return_counts=True) for i, j in zip(rest_ends[:-1], rest_ends[1:])]
                part = batch.slice(begin, many)
                yield pa.RecordBatch.from_arrays([
                    *part.select([c for c in part.schema.names if c not in "ab"]).columns,
                    pa.array(np.diff(starts)), pa.array([len(v.as_py()) // 2 for v in part.column(part.schema.get_field_index("b"))], pa.int64()),
                    pa.array(np.diff(bests)), pa.array(np.diff(total)),
                    pa.array([[{"pair": p, "links": c} for p, c in zip(*(x.tolist() for x in r))] for r in rest], _REST),
                ], names=[*[c for c in part.schema.names if c not in "ab"], "n_a", "n_b", "n_best", "count_sum", "rest"])

    kind = "key binary, copies bigint, n_groups bigint, n_links bigint, groups string, n_a bigint, n_b bigint, n_best bigint, count_sum bigint"
    found = materialise(texts.mapInArrow(run, f"{kind}, rest array<struct<pair:bigint,links:bigint>>"))
    # Links of the pairs beyond the table: joined by pair.
    rest = found.filter(F.size("rest") > 0).select("key", F.inline("rest"))
    seldom = counts.filter(F.col("n") < bound).join(
        F.broadcast(best), F.shiftright("pair", _ID_BITS) == F.col("a")
    ).select("pair", "n", (F.col("n") == F.col("best")).cast("bigint").alias("top"))
    more = rest.join(seldom, "pair").groupBy("key").agg(
        F.sum(F.col("links") * F.col("n")).alias("_sum"), F.sum(F.col("links") * F.col("top")).alias("_best")
    )
    return found.drop("rest").join(more, "key", "left").withColumns({
        "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
    }).drop("_sum", "_best")


_REST = pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())]))
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, folder: str = FOLDER, table: int = TABLE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    texts = materialise(encoded(docs, folder), compression="zstd")
    counts = materialise(pair_counts(texts, folder))
    measures = materialise(measured(texts, counts, folder, table))
    keyed = docs.select("doc_id", text_key("text"))
    hot = F.broadcast(measures.filter(F.col("copies") > max(1.0, HOT_SHARE * docs.count())).drop("copies"))
    often = keyed.join(hot, "key")
    seldom = keyed.join(hot.select("key"), "key", "left_anti").join(measures.drop("copies"), "key", "left")
    return often.unionByName(seldom).select(
        "doc_id", *[F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in MEASURES], F.coalesce("groups", F.lit("")).alias("groups_sha256")
    )


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The groups themselves: key (SHA-256 of the text), copies and an array of (a ids, b ids) per distinct text."""
    ids = lambda part: F.transform(F.split(part, ","), lambda i: i.cast("int"))
    pair = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    return encoded(docs, folder, digest=False).select("key", "copies", F.transform(F.split("groups", ";"), pair).alias("groups"))
