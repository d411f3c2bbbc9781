"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are dealt into blocks of equal length, in an order given by a
hash of their ids. One block is emitted per slot. A source of rate w owes its
block j between the times at which its fluid share reaches j and j + 1: these are
the block's release time and deadline, and among released blocks the earliest
deadline goes first. So no source is ever a whole block ahead of or behind its
share. When a source runs out, the others share its rate in proportion, from
where they stand. All rows are kept.

A block has ``block_rows`` rows at every size of the table, so the deviation in rows
doesn't grow with it. The schedule is made by one task as a stream of blocks, from
the sources' counts alone: its memory depends on the number of sources only, its
time on the number of blocks. Blocks reach their rows by way of buckets: rows fall
into buckets by hash, bucket counts are summed up per source, and only buckets are
sorted, so a source with a third of all rows is spread like the others.

A null source is a source of its own. Weights name sources; sources not named
share ``rest`` in proportion to their rows. Without weights, weights are the
rows' counts to the power ``temperature``. Repeated rows are kept. Null ids hash
alike and lie together. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPERATURE = 0.7
BLOCK_ROWS = 16
#: Rows that a bucket is to hold, in the mean.
BUCKET_ROWS = 1_000
#: Blocks of a batch of the schedule.
BATCH_BLOCKS = 8_192


def turns(blocks: list[int], weights: list[float]) -> Iterator[int]:
    """The source of each slot, by earliest deadline first among released blocks.

    Shares are kept as one fluid time: a source of weight w is due w * time blocks, so that its block j is released
    after time j / w and has its deadline at (j + 1) / w, whatever the others do. A slot takes 1 / (weights left).
    When a source runs out, what it still owes or has had too much shifts the time, which gives it to the others in
    proportion.
    """
    weight = [max(float(w), 1e-12) for w in weights]
    given = [0] * len(blocks)
    ready: list[tuple[float, int]] = []  # by deadline
    waiting = [(0.0, k) for k, n in enumerate(blocks) if n > 0]  # by release
    whole = sum(weight[k] for _, k in waiting)
    start, slot = 0.0, 0  # of the stretch in which no source has run out
    for _ in range(sum(blocks)):
        slot += 1
        end = start + slot / whole
        released = lambda k: weight[k] * end - given[k] > 1e-11 * (given[k] + 1)  # noqa: B023, E731
        while waiting and released(waiting[0][1]):
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, ((given[k] + 1) / weight[k], k))
        while ready and not released(ready[0][1]):  # the time was shifted back
            k = heapq.heappop(ready)[1]
            heapq.heappush(waiting, (given[k] / weight[k], k))
        k = heapq.heappop(ready or waiting)[1]
        given[k] += 1
        if given[k] < blocks[k]:
            heapq.heappush(waiting, (given[k] / weight[k], k))
        elif ready or waiting:
            whole = sum(weight[j] for _, j in (*ready, *waiting))
            start, slot = end + (weight[k] * end - given[k]) / whole, 0
        yield k


def schedule(blocks: list[int], weights: list[float]) -> list[list[int]]:
    """For each source the slots of its blocks."""
    slots: list[list[int]] = [[] for _ in blocks]
    for slot, k in enumerate(turns(blocks, weights)):
        slots[k].append(slot)
    return slots


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(n))


def _plan(spark, sources: list[str], counts: list[int], weights: list[float], rows: int) -> DataFrame:
    """(_s, _b, slot, _start): each block's source, number, slot and first position, made batch by batch in one task."""
    blocks = [-(-n // rows) for n in counts]

    def run(batches):
        from itertools import islice

        import pyarrow as pa

        for _ in batches:
            left, given, slot, start = turns(blocks, weights), [0] * len(blocks), 0, 0
            while batch := list(islice(left, BATCH_BLOCKS)):
                numbers, starts = [], []
                for k in batch:
                    numbers.append(given[k])
                    starts.append(start)
                    start += min(rows, counts[k] - given[k] * rows)
                    given[k] += 1
                arrays = [pa.array([sources[k] for k in batch], pa.string()), pa.array(numbers, pa.int64()), pa.array(range(slot, slot + len(batch)), pa.int64()), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["_s", "_b", "slot", "_start"])
                slot += len(batch)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "_s string, _b bigint, slot bigint, _start bigint")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    rest: float = 0.0,
    temperature: float = TEMPERATURE,
    block_rows: int = BLOCK_ROWS,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """The documents with block (number within the source), slot (of the block, from 0) and
    mix_position (of the row, from 0, gapless). Input columns of these names are replaced."""
    made = ("block", "slot", "mix_position")
    docs = docs.drop(*[c for c in made if c not in (id_column, source_column)])
    key = F.col(f"`{id_column}`")
    # never null, so that joins on it are plain equalities and reuse the window's exchange
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_column}`").cast("string")), F.lit("null"))
    by_source = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").collect()
    names = [None if r.s == "null" else r.s[1:] for r in by_source]
    total = sum(r.n for r in by_source)
    if weights is None:
        target = [float(r.n) ** temperature for r in by_source]
    else:
        unnamed = sum(r.n for r, name in zip(by_source, names, strict=True) if name not in weights)
        target = [weights[name] if name in weights else rest * r.n / unnamed for r, name in zip(by_source, names, strict=True)]
    buckets = max(1, total // BUCKET_ROWS)
    blocks = _plan(docs.sparkSession, [r.s for r in by_source], [r.n for r in by_source], target, block_rows)
    keyed = docs.withColumns({"_k": _bucket(key, buckets), "_src": source})
    sizes = keyed.groupBy("_src", "_k").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_src").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("_src").alias("_src2"), F.col("_k").alias("_k2"), F.coalesce("_before", F.lit(0)).alias("_before"), "_n")
    first, last = F.floor(F.col("_before") / block_rows).cast("bigint"), F.floor((F.col("_before") + F.col("_n") - 1) / block_rows).cast("bigint")
    # each bucket with the blocks that its rows lie in: the rows themselves are joined by the bucket alone
    spread = before.withColumn("_first", first).select("*", F.explode(F.sequence(first, last)).alias("_b2"))
    reached = spread.join(blocks, (F.col("_src2") == F.col("_s")) & (F.col("_b2") == F.col("_b")))
    reached = reached.groupBy("_src2", "_k2", "_before", "_first").agg(F.array_sort(F.collect_list(F.struct("_b", "slot", "_start"))).alias("_blocks"))
    order = Window.partitionBy("_src", "_k").orderBy(F.xxhash64(key), key, *[F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("string", "bigint", "int") and c != id_column and c != "text"])
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1)
    placed = ranked.join(reached, (F.col("_src") == F.col("_src2")) & (F.col("_k") == F.col("_k2"))).withColumn("_at", F.col("_rank") + F.col("_before"))
    placed = placed.withColumn("block", F.floor(F.col("_at") / block_rows).cast("bigint"))
    own = F.get("_blocks", (F.col("block") - F.col("_first")).cast("int"))
    placed = placed.withColumns({"slot": own["slot"], "mix_position": own["_start"] + F.col("_at") - F.col("block") * block_rows})
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *made)


def op8_mix(spark, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix whose weights are the sources' counts to the power 0.7."""
    from agora.llm.common import table

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "slot", "mix_position")
