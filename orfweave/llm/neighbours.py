"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to cells by the nearest of some centres. Each vector, less its centre, is rotated and reduced to the signs
of its coordinates (packed bits) with two correction scalars: its length, and the inner product of its direction with its
code. A query's inner product with a code is looked up byte by byte, corrected to an unbiased estimate of the distance, and
given an error bound. Vectors whose lower bound is not above the k-th smallest upper bound are reranked by exact distance.

A query looks into the cells with the nearest centres only, so it meets a share of the vectors that falls with their number:
there are about sqrt(n) cells. How many cells suffice is measured: for `PROBED` of the queries (the smallest hashed ids) all
vectors are compared, and as many cells are taken as the farthest of their k true neighbours needs. Data without any
clusters need most cells; the result stays right and the work grows.

The centres are fitted on at most `FIT_ROWS` vectors (those with the smallest hashed ids); every vector is indexed, and the
index is written once. A cell's vectors and queries meet in groups of about `ROWS` vectors and `BLOCK` queries, so neither a
cell that holds a third of all vectors nor one that a third of all queries look into fills a task. Only the centres, their
counts and the probed queries are sent to all tasks, each bounded by the constants here. Vectors of each length that a query
has are an index of their own.

Defined results: vectors that are null, zero, empty or hold nulls or non-finite numbers take no part; a query meets vectors
of its own length; ties go to the smaller id; with fewer than k candidates in its cells a query gets those; rows that repeat
an id are candidates of their own, but never for a query of the same id, and of queries that repeat an id the smallest vector
asks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

FIT_ROWS, ROUNDS = 16_384, 4
#: Cells that the sample can fit: four of its vectors for each.
MAX_CELLS = FIT_ROWS // 4
PROBED = 64
ROWS, BLOCK = 16_384, 512
#: Half-widths of the error bound in standard deviations of the estimate.
EPSILON = 4.0
INDEX = "cell int, vec_id long, vector binary, code binary, norm double, ip double"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and those vectors in double precision."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(values).all(1) & (values != 0).any(1)
    return at[fine], values[fine]


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign codes, lengths, and inner products of directions with their codes, of rotated vectors."""
    norm = np.linalg.norm(turned, axis=1)
    ip = np.abs(turned).sum(1) / (np.sqrt(turned.shape[1]) * np.where(norm > 0, norm, 1))
    return np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, ip, 1.0)


def by_centre(vectors: np.ndarray, centres: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances to all centres, less each vector's own square, for blocks of vectors."""
    squares = (centres**2).sum(1)
    step = max(1, (1 << 22) // len(centres))
    for i in range(0, len(vectors), step):
        yield squares - 2 * vectors[i : i + step] @ centres.T


def nearest_centres(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(d.argmin(1) for d in by_centre(vectors, centres))])


def lengths(df: DataFrame, queries: DataFrame, vector: str = "embedding") -> list[tuple[int, int]]:
    """(length, number of vectors) for each length of vectors that take part and that a query has."""

    def counted(rows: DataFrame) -> dict[int, int]:
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        fine = rows.where(F.col(vector).isNotNull()).where(~bad & F.exists(vector, lambda x: x != 0))
        return {r["n"]: r["count"] for r in fine.groupBy(F.size(vector).alias("n")).count().collect()}

    asked, every = counted(queries), counted(df)
    return sorted((n, every.get(n, 0)) for n in asked)


def fit(df: DataFrame, dim: int, count: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centres of cells for `count` vectors of length dim: k-means of a bounded sample."""
    sample = df.where(F.size(vector) == dim).select(vector, F.xxhash64(key).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(FIT_ROWS)
    _, found = valid_rows(sample.select(vector).toArrow()[vector].combine_chunks(), dim)
    n = max(1, min(int(np.ceil(np.sqrt(count))), MAX_CELLS, len(found)))
    centres = found[:n].copy() if len(found) else np.zeros((1, dim))
    for _ in range(ROUNDS):
        cell = nearest_centres(found, centres)
        sizes = np.bincount(cell, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, found)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def index(df: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector that takes part and has the centres' length, with its cell, code and correction scalars. Vectors keep
    the precision they came in."""
    dim = centres.shape[1]
    turn = rotation(dim)
    kind = np.float32 if df.schema[vector].dataType.elementType.simpleString() == "float" else np.float64

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = valid_rows(batch["v"], dim)
            if len(at):
                cell = nearest_centres(vectors, centres)
                code, norm, ip = encode((vectors - centres[cell]) @ turn.T)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch["k"].take(pa.array(at)), pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(ip)], ["cell", "vec_id", "vector", "code", "norm", "ip"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInArrow(coded, INDEX)


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    kind = np.float32 if len(data) == 4 * dim * len(column) else np.float64
    return np.frombuffer(data, dtype=kind).reshape(-1, dim).astype(np.float64)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added in the order of the components."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += (query[j] - vectors[:, j]) ** 2
    return np.sqrt(total)


def nearest(ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, norm: np.ndarray, ip: np.ndarray, qid: int, query: np.ndarray, turned: np.ndarray, k: int, epsilon: float, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of a block to one query, itself left out; limit: a distance that suffices."""
    dim = len(query)
    qnorm = np.linalg.norm(turned)
    # Sums of the query's coordinates, signed by each of 256 bytes, for each byte of a code.
    padded = np.zeros(8 * code.shape[1])
    padded[:dim] = turned
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    lookup = padded.reshape(-1, 8) @ signs.T
    inner = np.zeros(len(ids))
    for b in range(code.shape[1]):
        inner += lookup[b][code[:, b]]
    inner /= np.sqrt(dim)
    estimate = norm * inner / ip
    error = epsilon * norm * qnorm * np.sqrt(np.maximum(0, 1 - ip**2)) / (ip * np.sqrt(max(dim - 1, 1)))
    square = norm**2 + qnorm**2 - 2 * estimate
    others = ids != qid
    upper = (square + 2 * error)[others]
    if not len(upper):
        return ids[:0], np.zeros(0)
    bound = min(np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf, limit**2)
    at = np.flatnonzero(others & (square - 2 * error <= bound * (1 + 1e-9) + 1e-9))
    distance = exact(query, vectors[at])
    best = np.lexsort((ids[at], distance))[:k]
    return ids[at][best], distance[best]


def true_neighbours(indexed: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, cell) of the k nearest of all vectors, for a few queries that are sent to all tasks."""
    dim = vectors.shape[1]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, every, cell = batch["vec_id"].to_numpy(), _vectors(batch["vector"], dim), batch["cell"].to_numpy()
            out: list[list] = [[], [], [], []]
            for q, v in zip(ids, vectors, strict=True):
                distance = exact(v, every)
                best = np.lexsort((found, np.where(found == q, np.inf, distance)))[: k + 1]
                best = best[found[best] != q]
                for column, value in zip(out, (np.full(len(best), q), found[best], distance[best], cell[best]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score", "cell"])

    found = indexed.mapInArrow(scanned, "query_id long, vec_id long, score double, cell int")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int) -> int:
    """How many of the nearest cells hold all k nearest neighbours of each of the PROBED queries."""
    rows = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBED).select("vec_id", "vector").toArrow()
    if not len(rows):
        return 1
    ids, vectors = rows["vec_id"].to_numpy(), _vectors(rows["vector"], centres.shape[1])
    ranks = np.concatenate([d.argsort(1).argsort(1) for d in by_centre(vectors, centres)])
    place = {q: i for i, q in enumerate(ids)}
    return max([1, *(int(ranks[place[r["query_id"]], r["cell"]]) + 1 for r in true_neighbours(indexed, ids, vectors, k).select("query_id", "cell").collect())])


def search(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, epsilon: float = EPSILON, cells: int | None = None, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries, itself a part of an index. Both are tables that were written
    before. cells: how many cells a query looks into (measured if not given)."""
    dim, turn = centres.shape[1], rotation(centres.shape[1])
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    some = min(cells or probes(indexed, queries, centres, k), len(centres))

    def looking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch["vector"], dim)
            near = np.concatenate([np.zeros((0, some), np.int64), *(np.argpartition(d, some - 1, axis=1)[:, :some] for d in by_centre(vectors, centres))])
            at = pa.array(np.repeat(np.arange(len(vectors)), some))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["vector"].take(at), pa.array(near.ravel(), pa.int32())], ["query_id", "query", "cell"])

    asked = stored(queries.select("vec_id", "vector").mapInArrow(looking, "query_id long, query binary, cell int"), "asked")
    plan = indexed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("v")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("q")), "cell")
    plan = F.broadcast(plan)  # a row for each cell, at most MAX_CELLS
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(plan, "cell").withColumn("a", dealt("vec_id", "v")).withColumn("b", every("q")).drop("v", "q")
    right = asked.join(plan, "cell").withColumn("b", dealt("query_id", "q")).withColumn("a", every("v")).drop("v", "q")

    def met(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(held) and len(asking):
            centre = centres[held["cell"][0].as_py()]
            ids, vectors = held["vec_id"].to_numpy(), _vectors(held["vector"], dim)
            code = np.frombuffer(b"".join(held["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            norm, ip = held["norm"].to_numpy(), held["ip"].to_numpy()
            q_vectors = _vectors(asking["query"], dim)
            turned = (q_vectors - centre) @ turn.T
            for q, v, t in zip(asking["query_id"].to_numpy(), q_vectors, turned, strict=True):
                found, distance = nearest(ids, vectors, code, norm, ip, q, v, t, k, epsilon)
                for column, value in zip(out, (np.full(len(found), q), found, distance), strict=True):
                    column.append(value)
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    keys = ("cell", "a", "b")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, asking: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that `asking` holds for, its k nearest other rows."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, count in lengths(vectors, vectors.where(asking), vector):
        centres = fit(vectors, dim, count, key, vector)
        indexed = stored(index(vectors, centres, key, vector), "index")
        queries = stored(index(vectors.where(asking), centres, key, vector), "queries")
        out = out.unionByName(search(indexed, queries, centres, k))
    return out


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
