"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Centroids, the number of probed lists and a random rotation are fitted on a bounded sample; every
row is indexed. A query probes the lists whose centroids it has the largest products with. Inside a
list, vectors are rotated and compared column block by column block: after d of D columns, D/d times
the partial squared distance estimates the whole, and a hypothesis test (EPSILON) abandons a
candidate as soon as it can hardly reach the query's current k-th product. What survives is scored
exactly, in double precision on the original vectors.

How many lists are probed is not a guess: on the sample, brute force gives the true neighbours, and
the smallest number of lists that finds RECALL of them is taken. The sample is sparser than the
table, so the table's recall is rather higher. Queries that found fewer than k candidates in their
lists search all lists.

Lists are cut into blocks of BLOCK rows and their queries into parts of PART, so a list of any
size, and any number of queries for it, is spread over tasks; a task sees one block and one part.

Defined results: null, zero, non-finite and null-holding vectors take no part, nor do rows without
id or with another number of components than most; rows with the query's own id are no candidates;
equal query rows are one query; ties go to the smaller vec_id; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.llm.text import chosen
from lapsewise.session import materialise

K = 20
QUERY_EVERY = 20
SAMPLE, SAMPLE_QUERIES, RECALL = 8192, 256, 0.95
BLOCK, PART = 4096, 2048
COLUMNS, EPSILON = 16, 2.1
CHUNK = 512  # candidates between two updates of the k-th products


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    @property
    def dimension(self) -> int:
        return len(self.rotation)


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (array<float>) of the rows that take part."""
    usable = (
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    good = embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(usable)
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.size("embedding") == (sizes.d if sizes else 0))


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dimension)


def fit(vectors: DataFrame, total: int, k: int = K, seed: int = 5) -> Index:
    """Fit on at most about SAMPLE rows, chosen by a hash of vec_id."""
    lists = int(min(4096, max(32, total**0.5 / 8), max(total // 4, 1)))
    share = min(1.0, 1.2 * SAMPLE / total)
    some = vectors.filter(chosen(F.xxhash64("vec_id"), share))
    rows = some.orderBy(F.xxhash64("vec_id"), "embedding").limit(SAMPLE).collect()
    rows = rows or vectors.orderBy(F.xxhash64("vec_id"), "embedding").limit(SAMPLE).collect()
    # Copies of one vector count once, or they would hide how many lists the others need.
    x = np.unique(np.array([r.embedding for r in rows], np.float64), axis=0)
    random = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(random.normal(size=(x.shape[1], x.shape[1])))
    lists = min(lists, len(x))
    centroids = x[random.choice(len(x), lists, replace=False)]
    for _ in range(12):
        nearest = _lists_of(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        held = np.bincount(nearest, minlength=lists)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], x[random.choice(len(x), lists)])
    return Index(centroids, rotation, _probes_needed(x, centroids, k))


def _lists_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def _probes_needed(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    asked = np.unique(np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int))
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not best.shape[1]:
        return len(centroids)
    order = np.argsort(-(x[asked] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.take_along_axis(place, _lists_of(x, centroids)[best], axis=1) + 1
    found = np.searchsorted(np.sort(needed.ravel()), np.arange(1, len(centroids) + 1), side="right") / needed.size
    return int(np.argmax(found >= RECALL)) + 1


def index(vectors: DataFrame, model: Index) -> DataFrame:
    """vec_id, embedding, list and block of every vector, written."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def assign(batches):
        for batch in batches:
            model = sent.value
            found = _lists_of(_matrix(batch.column(1), model.dimension).astype(np.float64), model.centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], names=["vec_id", "embedding", "list"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    listed = vectors.mapInArrow(assign, f"vec_id {kind}, embedding array<float>, list int")
    return materialise(listed)


def _probed(queries: DataFrame, model: Index, probes: int) -> DataFrame:
    """One row per query and list to search; `place` 0 is the nearest."""
    sent = queries.sparkSession.sparkContext.broadcast(model)

    def choose(batches):
        for batch in batches:
            model = sent.value
            products = _matrix(batch.column(2), model.dimension).astype(np.float64) @ model.centroids.T
            best = np.argsort(-products, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best))], names=["query_id", "query", "embedding", "lists"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = queries.mapInArrow(choose, f"query_id {kind}, query bigint, embedding array<float>, lists array<int>")
    return found.select("query_id", "query", "embedding", F.posexplode("lists").alias("place", "list"))


def scan(
    q: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, own: np.ndarray | None = None, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandoned and that reach the query's k-th product.

    `own` marks pairs that do not count; `floor` holds products that k candidates elsewhere reach.
    Candidates come in chunks, between which the k-th products rise. Within a chunk all queries take
    a column block together, as one matrix product while many pairs are alive, pair by pair after.
    """
    dimension = x.shape[1]
    turned_q, turned_x = (q @ rotation).astype(np.float32), (x @ rotation).astype(np.float32)
    norm_q, norm_x = (turned_q**2).sum(axis=1), (turned_x**2).sum(axis=1)
    loose = 1e-4 * (norm_q[:, None] + 1)  # single precision
    best = np.full((len(q), k), -np.inf, np.float32)
    if floor is not None:
        best[:] = floor[:, None].astype(np.float32)
    kept = []
    for begin in range(0, len(x), CHUNK):
        part, size = turned_x[begin : begin + CHUNK], norm_x[begin : begin + CHUNK]
        both = norm_q[:, None] + size[None, :]
        limit = np.maximum(both - 2 * best[:, :1], 0) + loose * (1 + size[None, :])
        alive = np.ones(limit.shape, bool) if own is None else ~own[:, begin : begin + CHUNK]
        partial, done = np.zeros(limit.shape, np.float32), 0
        pairs = None
        while done < dimension:
            width = min(COLUMNS, dimension - done)
            head_q, head_x = turned_q[:, done : done + width], part[:, done : done + width]
            done += width
            slack = (1 + EPSILON / done**0.5) ** 2 if done < dimension else 1.0
            if pairs is None:
                partial += (head_q**2).sum(axis=1)[:, None] + (head_x**2).sum(axis=1)[None, :] - 2 * head_q @ head_x.T
                alive &= partial * (dimension / done) <= limit * slack
                if done < dimension and np.count_nonzero(alive) < alive.size // 16:
                    pairs = np.nonzero(alive)
                    partial = partial[pairs]
            else:
                i, j = pairs
                partial = partial + ((head_q[i] - head_x[j]) ** 2).sum(axis=1)
                still = partial * (dimension / done) <= limit[i, j] * slack
                pairs, partial = (i[still], j[still]), partial[still]
        if pairs is None:
            pairs = np.nonzero(alive)
            partial = partial[pairs]
        i, j = pairs
        products = (both[i, j] - partial) / 2
        kept.append((i, begin + j, products))
        if len(i):
            rows, at = np.unique(i, return_inverse=True)
            fresh = np.full((len(rows), part.shape[0]), -np.inf, np.float32)
            fresh[at, j] = products
            together = np.concatenate((best[rows], fresh), axis=1)
            together = np.partition(together, together.shape[1] - k, axis=1)[:, -k:]
            best[rows] = np.sort(together, axis=1)
    i, j, products = (np.concatenate(c) for c in zip(*kept))
    near = products >= best[i, 0] - loose[i, 0] * (1 + norm_x[j])
    return i[near], j[near]


def search(indexed: DataFrame, probed: DataFrame, model: Index, k: int) -> DataFrame:
    """query_id, query, vec_id, score: what may be among the best k in every block that a query meets.

    `probed` holds query_id, query, embedding, list and floor.
    """
    sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    parts = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    shape = materialise(sizes.join(parts, "list"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = probed.join(shape, "list").withColumn("part", F.pmod(F.col("query"), F.col("parts")).cast("int"))
    asks = asks.withColumn("block", spread("blocks")).select("query_id", "query", "embedding", "floor", "list", "block", "part")
    holds = indexed.join(shape, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    holds = holds.withColumn("part", spread("parts")).select("vec_id", "embedding", "list", "block", "part")
    rotation = indexed.sparkSession.sparkContext.broadcast(model.rotation)

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        q = np.stack(asked["embedding"].to_numpy()).astype(np.float64)
        x = np.stack(held["embedding"].to_numpy()).astype(np.float64)
        ids, mine = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        i, j = scan(q, x, rotation.value, k, mine[:, None] == ids[None, :], asked["floor"].to_numpy(np.float64))
        score = (x[j] * q[i]).sum(axis=1)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        i, j, score = i[place < k], j[place < k], score[place < k]
        return pd.DataFrame({"query_id": mine[i], "query": asked["query"].to_numpy()[i], "vec_id": ids[j], "score": score})

    key = ["list", "block", "part"]
    kind = indexed.schema["vec_id"].dataType.simpleString()
    return asks.groupBy(*key).cogroup(holds.groupBy(*key)).applyInPandas(
        compare, f"query_id {kind}, query bigint, vec_id {kind}, score double"
    )


def _two_rounds(indexed: DataFrame, queries: DataFrame, model: Index, probes: int, k: int) -> DataFrame:
    """The best k in the nearest `probes` lists. The nearest list comes first: its k-th product is the others' floor."""
    probed = materialise(_probed(queries, model, probes))
    first = materialise(best_of(search(indexed, probed.filter("place = 0").withColumn("floor", F.lit(float("-inf"))), model, k), k))
    floors = first.filter(F.col("rank") == k).select("query_id", "query", F.col("score").alias("floor"))
    rest = probed.filter("place > 0").join(floors, ["query_id", "query"], "left").fillna(float("-inf"), ["floor"])
    return best_of(first.drop("rank").unionByName(search(indexed, rest, model, k)), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    nearest = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def neighbours(embeddings: DataFrame, is_query: Column | None = None, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found."""
    is_query = F.col("vec_id") % QUERY_EVERY == 0 if is_query is None else is_query
    vectors = materialise(valid(embeddings))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    total = vectors.count()
    if not total:
        return embeddings.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    model = fit(vectors, total, k)
    indexed = index(vectors, model)
    queries = vectors.filter(is_query).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "embedding").alias("query"), "embedding"
    ).dropDuplicates(["query_id", "query"])
    found = materialise(_two_rounds(indexed, queries, model, model.probes, k))
    if model.probes < len(model.centroids):
        enough = found.groupBy("query_id", "query").count().filter(F.col("count") >= min(k, total - 1))
        short = materialise(queries.join(enough, ["query_id", "query"], "left_anti"))
        if not short.isEmpty():
            again = _two_rounds(indexed, short, model, len(model.centroids), k)
            found = found.join(short.select("query_id", "query"), ["query_id", "query"], "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
