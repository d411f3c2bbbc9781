"""Approximate nearest neighbours by multiprobe p-stable hashing.

Directions are hashed by tables of functions floor((a.x + b) / width) with normal
(2-stable) a; a bucket is a table's combination of cells. Every row is indexed once
in each table. A query's probes are its own bucket and perturbed ones in the order of
estimated success: the sum over the functions of the squared distance from the
query's projection to the bucket's interval, least first. The sequence is generated,
function by function, up to a table's ``reach``, and joined with the index on the
bucket alone. Each bucket's rows are compared by exact cosine on the original
vectors, its best ``k`` for a query leave it, and the tables' answers are merged.
Queries that have found fewer than ``k`` go on probing at four times the reach.

``fit`` draws the functions from a seed, as many as give buckets of about
``BUCKET_ROWS`` rows, and chooses the number of tables and the reach on a bounded
sample: the reach is the score within which a ``recall`` share of the sample's true
neighbours lie in at least one table, and of the numbers of tables the one that
visits the fewest rows so is taken. Neighbours among all rows are nearer than those
in a sample, so the recall over all rows is higher. Vectors without near neighbours
need a wide reach: the hash then excludes little.

A crowded bucket is cut into blocks of rows and of queries by hashes of their ids,
so a bucket with a third of all rows is spread as well. Ties go to the smaller id.

Vectors that are null, empty or zero, or hold null or non-finite components, take
no part, nor do vectors of another length than the most frequent one. A repeated
id's rows are candidates each; a query's own id is never its candidate, and of
repeated query ids the one with the least vector is asked. Other columns, whatever
their names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import Scratch
from agora.llm.vectors import cosines, doubles, matrix, units, usable

SAMPLE_ROWS, SAMPLE_QUERIES = 4_096, 256
MOST_TABLES, MOST_FUNCTIONS, WIDTH, RECALL = 6, 8, 0.9, 0.97
#: Rows that a bucket is to hold, and bits that one function tells on directions at this width, about.
BUCKET_ROWS, FUNCTION_BITS = 1_024, 2.2
#: Rows of an index block and queries of a query block of a crowded bucket.
INDEX_ROWS, QUERY_ROWS = 1_024, 8_192
#: Bucket counts of up to this many buckets are broadcast (four numbers each).
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class Hashing:
    seed: int
    size: int
    tables: int = 1
    functions: int = 1
    width: float = WIDTH
    reach: float = math.inf

    def project(self, x):
        """Projections in units of the width: (tables, rows, functions)."""
        import numpy as np

        r = np.random.default_rng(self.seed)
        a = r.standard_normal((MOST_TABLES, self.size, self.functions))[: self.tables]
        b = r.random((MOST_TABLES, 1, self.functions))[: self.tables]
        return np.einsum("ns,tsf->tnf", units(x), a) / self.width + b


def functions_for(rows: int) -> int:
    return max(1, min(MOST_FUNCTIONS, round(math.log2(max(2, rows) / BUCKET_ROWS) / FUNCTION_BITS)))


def fit(vectors: DataFrame, size: int, count: int, seed: int = 7, k: int = 5, recall: float = RECALL) -> Hashing:
    """Functions from the seed; tables and reach from at most SAMPLE_ROWS rows, those with the smallest hash of their id."""
    import numpy as np

    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select("v").collect()
    h = Hashing(seed, size, MOST_TABLES, functions_for(count))
    x = np.unique(np.array([r.v for r in sample], dtype=float).reshape(-1, size), axis=0)
    if len(x) <= k + 1:
        return replace(h, tables=1)
    x = x[np.random.default_rng(seed).permutation(len(x))]
    p, u = h.project(x), units(x)
    cells = np.floor(p)
    least, scores = [], []
    for q in range(min(SAMPLE_QUERIES, len(x))):
        s = u @ u[q]
        s[q] = -2
        gap = np.maximum(np.maximum(cells - p[:, q][:, None], p[:, q][:, None] - cells - 1), 0.0)
        scores.append((gap**2).sum(-1))
        least.append(scores[-1][:, np.argpartition(-s, k)[:k]])
    least, scores = np.concatenate(least, axis=1), np.concatenate(scores, axis=1)
    reaches = [float(np.quantile(least[:t].min(axis=0), recall)) for t in range(1, MOST_TABLES + 1)]
    visited = [float((scores[: t + 1] <= reach).sum()) for t, reach in enumerate(reaches)]
    best = int(np.argmin(visited))
    return replace(h, tables=best + 1, reach=reaches[best])


def buckets_of(cells):
    """A number for each combination of cells (..., functions); a clash would only add candidates."""
    import numpy as np

    out = np.zeros(cells.shape[:-1], np.uint64)
    for f in range(cells.shape[-1]):
        out = (out ^ cells[..., f].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def probes(projected, low, high, reach: float):
    """(query, cells, score) of the buckets within reach of each query's projection (queries, functions), least score
    first for each query. Cells outside low..high hold no rows."""
    import numpy as np

    query, cells, score = np.arange(len(projected)), np.zeros((len(projected), 0), np.int64), np.zeros(len(projected))
    for f in range(projected.shape[1]):
        choice = np.arange(low[f], high[f] + 1)
        at = projected[query, f][:, None]
        total = score[:, None] + np.maximum(np.maximum(choice - at, at - choice - 1), 0.0) ** 2
        i, j = np.nonzero(total <= reach)
        query, cells, score = query[i], np.concatenate([cells[i], choice[j][:, None]], axis=1), total[i, j]
    order = np.lexsort((score, query))
    return query[order], cells[order], score[order]


def _bucket_best(ids, x, query_ids, queries, k: int):
    """(query, id, score, many) of each query's best k among the bucket's rows; equal ids and scores are one, counted."""
    import numpy as np

    u, out = units(x), []
    for a in range(0, len(queries), 256):
        near = units(queries[a : a + 256]) @ u.T
        for j, s in enumerate(near, a):
            rows = np.flatnonzero(ids != query_ids[j])
            if len(rows) > k:
                s = s[rows]  # all that may tie with the k-th stay for the exact score and the order by id
                rows = rows[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
            if not len(rows):
                continue
            exact = cosines(x[rows], queries[j])
            best = np.lexsort((ids[rows], -exact))[:k]
            found, many = np.unique(np.array([ids[rows[best]].astype(np.int64), exact[best].view(np.int64)]), axis=1, return_counts=True)
            out.append((np.full(len(many), query_ids[j]), found[0], found[1].view(np.float64), many))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]


def _visit(index: DataFrame, asked: DataFrame, h: Hashing, low, high, k: int, index_rows: int, query_rows: int, scratch: Scratch) -> DataFrame:
    """(query_id, id, score, many) of the queries' best in the buckets that they probe; many counts rows of equal id."""

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            for t, p in enumerate(h.project(x)):
                for a in range(0, len(p), 1024):
                    query, cells, _ = probes(p[a : a + 1024], low[t], high[t], h.reach)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), t, np.int32)), pa.array(buckets_of(cells)), batch.column(0).take(pa.array(query + a))], names=["t", "bucket", "id"])

    visits = scratch.keep(asked.select("id", "v").mapInArrow(probe, "t int, bucket bigint, id bigint"))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = lambda df, size, name: df.groupBy("t", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    both = scratch.keep(parts(index, index_rows, "nr").join(parts(visits, query_rows, "nq"), ["t", "bucket"]))
    both = F.broadcast(both) if both.count() <= MOST_BROADCAST else both
    rows = index.join(both, ["t", "bucket"]).select("t", "bucket", "id", "v", block("nr", 11).alias("r"), every("nq").alias("c"))
    vectors = F.broadcast(asked) if asked.count() <= 4 * QUERY_ROWS else asked
    ask = visits.join(both, ["t", "bucket"]).select("t", "bucket", "id", every("nr").alias("r"), block("nq", 13).alias("c")).join(vectors, "id")

    def run(left, right):
        import pyarrow as pa

        columns = ["query_id", "id", "score", "many"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in columns})
        get = lambda t: (t["id"].to_numpy(), matrix(t["v"].combine_chunks()))
        return pa.table(dict(zip(columns, map(pa.array, _bucket_best(*get(left), *get(right), k)), strict=True)))

    keys = ["t", "bucket", "r", "c"]
    return rows.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(run, "query_id bigint, id bigint, score double, many bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each query its k nearest by cosine, nearest first."""
    import numpy as np

    def prepared(df):
        out = df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), doubles(df, vector_column).alias("v"))
        return out.filter(F.col("id").isNotNull() & usable(F.col("v")))

    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = prepared(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_column} bigint, score double")
    size, count = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == size)
    asked = scratch.keep(prepared(queries).filter(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")))
    h = fit(rows, size, count, k=k)

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            for t, p in enumerate(h.project(x)):
                cells = np.floor(p).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(buckets_of(cells)), pa.array(list(cells), pa.list_(pa.int64())), *batch.columns], names=["t", "bucket", "cells", "id", "v"])

    index = scratch.keep(rows.mapInArrow(hashed, "t int, bucket bigint, cells array<bigint>, id bigint, v array<double>"))
    range_of = [F.array(*[g(F.col("cells")[f]) for f in range(h.functions)]) for g in (F.min, F.max)]
    found = {r.t: r for r in index.groupBy("t").agg(range_of[0].alias("low"), range_of[1].alias("high")).collect()}
    low, high = [found[t].low for t in range(h.tables)], [found[t].high for t in range(h.tables)]
    index, reach, answers = index.drop("cells"), h.reach, None
    while True:
        new = scratch.keep(_visit(index, asked, replace(h, reach=reach), low, high, k, index_rows, query_rows, scratch))
        answers = new if answers is None else answers.unionByName(new)
        if math.isinf(reach):
            break
        full = new.groupBy("query_id").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= k)
        asked = scratch.keep(asked.join(full, asked.id == full.query_id, "left_anti"))
        if asked.isEmpty():
            break
        widest = sum((max(b) - min(a) + 1) ** 2 for a, b in zip(low, high, strict=True)) * h.functions
        reach = math.inf if 4 * reach > widest or not reach else 4 * reach
    # a row that several tables found is one candidate; equal ids with one score are as many as one table holds
    merged = answers.groupBy("query_id", "id", "score").agg(F.max("many").alias("many"))
    each = merged.select("query_id", "id", "score", F.explode(F.sequence(F.lit(1), F.col("many").cast("int"))).alias("_copy"))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    final = Scratch(spark).keep(best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score"), last=True)
    scratch.drop()
    return final


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    from agora.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"), 5)
