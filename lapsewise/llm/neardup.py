"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find grouping.

A document's set holds its distinct runs of five words (one run of all words when there are
fewer), as 64-bit hashes; documents with 100 x intersection >= 75 x union are linked, and groups
are what links reach. The steps:

1. One pass over the texts gives per document the set size, a 128-bit name of the set and a
   SuperMinHash signature cut into bands.
2. Documents with one set are one class from here on, however many they are.
3. Classes sharing a band are candidates; their full sets are made from the texts again, where the texts
   lie: bit maps of the wanted ids, of bounded size, say which texts to read. Every class
   meets the centre of each of its buckets, so these pairs stay linear in the classes, whatever a
   bucket holds. Pairs whose sizes alone rule a link out are left out.
4. Links become groups by union-find inside partitions and star contraction between them.
5. Buckets that still hold several groups are compared in full, in blocks of bounded size, by
   products of presence matrices; a task returns only the links that join groups. Buckets with the same
   members are compared once. Step 4 again.

Crowded buckets are dealt in slices, and joined slice by slice. The documents that a group loses are dropped by broadcast
joins of at most LOST_PARTS parts of LOST_ROWS rows each; beyond that by a shuffled join.

Every link is confirmed on full sets. A pair at exactly the threshold shares no band with a chance
of 5e-6; nothing is capped.

Defined results: a text without words has an empty set and is linked with nothing; equal rows are
copies of each other; a null doc_id never names a group that has other ids; input columns called
like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.llm import text as T
from lapsewise.session import materialise

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
PERCENT = 75
# Shingles hashed at a time; rows and set elements of a block; cells of a presence matrix.
CHUNK, BLOCK, ELEMENTS, CELLS = 300_000, 2048, 2_000_000, 1 << 23
# Members of a bucket that travel together; nodes a task holds in a forest.
SLICE, NODES = 1024, 1_000_000
# Bits of a map of wanted ids, at least MAP_BITS_EACH an id; rows of a broadcast part of lost documents, and parts.
MAP_BITS, MAP_BITS_EACH = 1 << 27, 16
LOST_ROWS, LOST_PARTS = 250_000, 8

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW32 = np.uint64(0xFFFFFFFF)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word runs."""
    return np.unique(T.sequence_hashes(T.word_hashes(T.lowered(text)), SHINGLE))


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One signature row per set.

    Every element walks its own random permutation of the slots: at step j it offers j plus a
    random fraction to the next slot of its permutation. As offers of step j are at least j, a set
    stops when its largest value is below the next step, which for long texts is at once. All sets
    take a step together, and leave when they are done.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), slots), _NONE, np.uint64)
    if not sizes.sum():
        return best
    element = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(slots):
        if step:
            going = (best.max(axis=1) >= np.uint64(step << 32)) & (sizes > 0)
            if not going.any():
                break
            keep = going[row]
            if not keep.all():
                element, row = element[keep], row[keep]
                order = order if order is None else order[keep]
            if order is None:  # the sets that go on need their permutation: redo its first swap
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
                first = T.mix(element + _GOLDEN) & _LOW32
                at = ((first * np.uint64(slots)) >> np.uint64(32)).astype(np.intp)
                order[np.arange(len(element)), at] = 0
                order[:, 0] = at
        bits = T.mix(element + np.uint64(int(_GOLDEN) * (step + 1) % 2**64))
        at = (((bits & _LOW32) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.intp) + step
        if order is None:
            slot = at
        else:
            lines = np.arange(len(element))
            slot = order[lines, at]
            order[lines, at] = order[:, step]
            order[:, step] = slot
        offer = (bits >> np.uint64(32)) | np.uint64(step << 32)
        np.minimum.at(best.reshape(-1), row * slots + slot, offer)
    return best


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    cells = signatures.reshape(len(signatures), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cells.shape[:2])
    for i in range(ROWS):
        value = T.mix(value * np.uint64(31) + cells[:, :, i])
    return value


def set_name(items: np.ndarray) -> bytes | None:
    """128 bits that name a set."""
    if not len(items):
        return None
    with np.errstate(over="ignore"):
        two = np.array([T.mix(items).sum(), T.mix(items ^ _GOLDEN).sum() + np.uint64(len(items))], np.uint64)
    return T.mix(two).tobytes()


def _sign(batches):
    for batch in batches:
        texts, begin = batch.column(batch.num_columns - 1), 0
        while begin < len(texts):
            sets, held = [], 0
            while begin + len(sets) < len(texts) and held < CHUNK:
                sets.append(shingles(texts[begin + len(sets)].as_py()))
                held += len(sets[-1])
            signed = super_minhash(sets)
            bands = band_hashes(signed).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays([
                *[c.slice(begin, len(sets)) for c in batch.columns[:-1]], pa.array([set_name(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([list(b) if f else [] for b, f in zip(bands, full)], pa.list_(pa.int64())),
            ], names=[*batch.schema.names[:-1], "class", "n", "bands"])
            begin += len(sets)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text as it is), class (name of the set, null when empty), n, bands."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_sign, f"doc_id {kind}, key bigint, class binary, n bigint, bands array<bigint>")


def _id_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.lit("set"))


def _id_map(wanted: DataFrame, bits: int) -> np.ndarray:
    """A bit map of hashed ids. Tasks hand on its words that are not empty, so at most `bits` bits reach the driver."""
    at = F.shiftrightunsigned(_id_key(F.col("doc_id")), 64 - bits.bit_length() + 1)
    words = wanted.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, items (sorted 64-bit hashes) for a table of (class, doc_id): a text of each class is read again.

    Texts are not moved: a bit map of the wanted ids goes to them, and sets that it lets through by chance are dropped
    by class. With more ids than a map may hold, several maps and passes take a part of the ids each.
    """
    many = wanted.count()
    parts = max(1, -(-many * MAP_BITS_EACH // MAP_BITS))
    bits = min(MAP_BITS, 1 << max(10, (many * MAP_BITS_EACH).bit_length()))
    texts = docs.select(_id_key(F.col("doc_id")).alias("k"), F.col("text").cast("string").alias("text"))
    found = None
    for part in range(parts):
        mine = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        sent = docs.sparkSession.sparkContext.broadcast(_id_map(mine, bits))
        shift = np.uint64(64 - bits.bit_length() + 1)

        def sets(batches, sent=sent, shift=shift):
            words = sent.value
            for batch in batches:
                at = batch.column(0).to_numpy().view(np.uint64) >> shift
                there = words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64) & 1
                for i in np.flatnonzero(there).tolist():
                    items = shingles(batch.column(1)[i].as_py())
                    if len(items):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([set_name(items)], pa.binary()), pa.array([items.tobytes()], pa.binary())], names=["class", "items"]
                        )

        some = texts.mapInArrow(sets, "class binary, items binary")
        found = some if found is None else found.union(some)
    # One row per class: the copies' ids are not wanted, so few classes come twice.
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def check(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("ia"), batch.column("ib")):
                a, b = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda p: sets.select(F.col("class").alias(p), F.col("items").alias(f"i{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ia", "ib").mapInArrow(check, "a binary, b binary")


def _forest(batches):
    """Union-find over the edges of a partition: one edge from every node to the smallest it reaches, NODES at a time."""
    parent: dict[bytes, bytes] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars():
        edges = [(x, root(x)) for x in parent]
        edges = [e for e in edges if e[0] != e[1]]
        for k in range(0, len(edges), 10_000):
            part = edges[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in part], pa.binary()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:  # the edges so far say the same as what they are made of
            yield from stars()
            parent.clear()
    yield from stars()


def groups(links: DataFrame) -> DataFrame:
    """(class, root): every linked class with the smallest class it reaches.

    Partitions are joined into forests first; then, until nothing changes, every node hands its
    larger neighbours, and then its smaller ones, to the smallest it knows.
    """
    edges = materialise(links.select("a", "b").mapInArrow(_forest, "u binary, v binary"))

    def seen(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while (now := seen(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        edges = materialise(small.filter("u != v").distinct())
    return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))


def _with_root(df: DataFrame, found: DataFrame) -> DataFrame:
    return df.join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))


def _per_slice(bands: DataFrame) -> DataFrame:
    """A table of one row per band, once for every slice of the band."""
    return bands.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))


def _buckets(classes: DataFrame) -> DataFrame:
    """band, slice, class, n of the bands that several classes share; crowded bands are cut into slices."""
    banded = classes.select(F.explode("bands").alias("band"), "class", "n")
    # Slices are counted before anything is joined, with classes dealt to a fixed number of them first.
    fine = banded.withColumn("fine", F.pmod(F.xxhash64("class"), F.lit(SLICE)).cast("int"))
    sizes = fine.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    slices = F.least(F.lit(SLICE), F.ceil(F.col("members") / F.lit(SLICE))).cast("int")
    sizes = sizes.select("band", slices.alias("slices"))
    crowded = sizes.filter("slices > 1")
    if crowded.isEmpty():
        return banded.join(sizes, "band").select("band", F.lit(0).alias("slice"), "class", "n")
    # At most 32 x classes / SLICE bands are crowded; those beyond the bound of a broadcast are left to Spark's measured choice.
    marked = fine.join(crowded, "band", "left").withColumn("slice", F.coalesce(F.pmod("fine", "slices"), F.lit(0)))
    return marked.drop("slices", "fine").join(_per_slice(sizes), ["band", "slice"]).select("band", "slice", "class", "n")


def _spread(bands: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows per band, repeated for the slices that the band has."""
    slices = buckets.groupBy("band").agg((F.max("slice") + 1).alias("slices"))
    return _per_slice(bands.join(slices, "band")).drop("slices")


def _sizes_fit(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _centre_pairs(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's centre."""
    centres = buckets.groupBy("band").agg(F.min("class").alias("centre"), F.min_by("n", "class").alias("m"))
    met = buckets.join(_spread(centres, buckets), ["band", "slice"]).filter("class != centre")
    return met.filter(_sizes_fit(F.col("n"), F.col("m"))).select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()


def _without_centres(buckets: DataFrame) -> DataFrame:
    """Members of buckets that still hold several groups, without the centres, which have met every member.

    Of buckets with the same members one is kept.
    """
    ends = [F.min("root").alias("low"), F.max("root").alias("high")]
    left = buckets.groupBy("band").agg(F.min("class").alias("centre"), *ends).filter("low != high")
    rest = buckets.join(_spread(left.select("band", "centre"), buckets), ["band", "slice"]).filter("class != centre").drop("centre")
    named = F.xxhash64("class")
    several = rest.groupBy("band").agg(
        *ends, F.count(F.lit(1)).alias("members"), F.sum(named.cast("decimal(20,0)")).alias("total"), F.bit_xor(named).alias("all"),
    ).filter("low != high")
    several = several.groupBy("members", "total", "all").agg(F.min("band").alias("band")).select("band")
    return rest.join(_spread(several, buckets), ["band", "slice"])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, as products of presence matrices."""
    common = np.zeros((len(a), len(b)), np.float32)
    items, place = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    shared = np.bincount(place, minlength=len(items)) > 1
    at = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    at, row = at[keep], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    wanted = int(shared.sum())
    width = max(1, min(wanted, CELLS // (len(a) + len(b))))
    for begin in range(0, wanted, width):
        lo, hi = np.searchsorted(at, (begin, begin + width))
        present = np.zeros((len(a) + len(b), width), np.float32)
        present[row[lo:hi], at[lo:hi] - begin] = 1
        common += present[: len(a)] @ present[len(a) :].T
    return common


def _between(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """Links between rows of different groups, only as many as join what they reach."""
    a, b = ([np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right))
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    linked = (100 + PERCENT) * _common(a, b) >= PERCENT * (na[:, None] + nb[None, :])
    codes, _ = pd.factorize(pd.concat((left["root"], right["root"])))
    codes, out = codes.copy(), []
    for k in range(len(a)):
        others = np.flatnonzero(linked[k] & (codes[len(a) :] != codes[k]))
        reached, first = np.unique(codes[len(a) + others], return_index=True)
        out += [(left["class"].iat[k], right["class"].iat[others[f]]) for f in first]
        codes[np.isin(codes, reached)] = codes[k]
    return out


def _block_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different groups of a bucket; large buckets are compared block against block.

    A task holds two blocks, each of at most BLOCK rows and about ELEMENTS set elements. What it
    returns joins groups, so there are fewer links than rows.
    """
    rows = buckets.join(sets, "class")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("items") / 8).alias("elements"))
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("elements") / F.lit(ELEMENTS))).cast("int")
    rows = rows.join(sizes.select("band", blocks.alias("blocks")), "band")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = rows.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "root", "items")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["root"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []})
        left, right = (pdf, pdf) if key[1] == key[2] else (pdf[pdf["mine"] == key[1]], pdf[pdf["mine"] == key[2]])
        found = _between(left, right) if len(left) and len(right) else []
        return pd.DataFrame([(min(p), max(p)) for p in found], columns=["a", "b"])

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set: class, rep (smallest doc_id), n, bands."""
    full = signed.filter("n > 0")
    return full.groupBy("class").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))


def find_groups(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, root) of all linked classes, from the written signatures."""
    classes = materialise(classes_of(signed))
    buckets = materialise(_buckets(classes))
    wanted = materialise(classes.join(buckets, "class", "left_semi").select("class", F.col("rep").alias("doc_id")))
    sets = materialise(_full_sets(docs, wanted))
    links = materialise(_confirmed(_centre_pairs(buckets), sets))
    found = groups(links)
    left = materialise(_without_centres(_with_root(buckets, found)))
    if left.isEmpty():
        return found
    # The groups so far are stars, to which the further links are added.
    return groups(found.select(F.col("class").alias("a"), F.col("root").alias("b")).union(_block_links(left, sets)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (doc_id = component_id)."""
    signed = materialise(signatures(docs))
    found = find_groups(signed, docs)
    named = signed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    rooted = _with_root(named, found)
    components = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    members = rooted.join(components, "root").select("class", "component_id")
    return signed.select("doc_id", "class", "n").join(members, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _lacking(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """The documents without (or, `left_semi`, only those with) the written rows of (_id, _key).

    The documents are not moved as long as the rows fit LOST_PARTS broadcasts.
    """
    def same(named):
        return docs["doc_id"].eqNullSafe(named["_id"]) & (F.xxhash64(docs["text"]) == named["_key"])

    parts = max(1, -(-rows.count() // LOST_ROWS))
    if parts > LOST_PARTS:
        return docs.join(rows, same(rows), how)
    out = None
    for part in range(parts):
        few = F.broadcast(rows.filter(F.pmod("_key", F.lit(parts)) == part))
        if how == "left_semi":
            some = docs.join(few, same(few), how)
            out = some if out is None else out.union(some)
        else:
            out = (docs if out is None else out).join(few, same(few), how)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of every group, the one with the smallest doc_id, and all documents without words."""
    signed = materialise(signatures(docs))
    rooted = _with_root(signed.filter("n > 0").select("class").distinct(), find_groups(signed, docs))
    # Rows that equal each other in id and text are one document that stands there several times.
    alike = signed.filter("n > 0").groupBy("doc_id", "key").agg(F.any_value("class").alias("class"), F.count(F.lit(1)).alias("times"))
    rows = materialise(alike.join(rooted, "class").select("root", "doc_id", "key", "times"))
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("best")).select("best.*")
    named = [F.col("doc_id").alias("_id"), F.col("key").alias("_key")]
    # A row is the best of its group or of none, so the group needs no join.
    best = kept.select(*named)
    lost = rows.join(best, rows["doc_id"].eqNullSafe(best["_id"]) & (rows["key"] == best["_key"]), "left_anti").select(*named)
    rest = _lacking(docs, materialise(lost))
    twice = materialise(rows.filter("times > 1").select(*named))
    if twice.isEmpty():
        return rest
    once = _lacking(rest, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return _lacking(rest, twice).unionByName(once)
