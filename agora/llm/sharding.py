"""Shards of near-equal size by histogram sort.

Rows are ordered by (64-bit hash of the text, id): equal texts lie together, and a
large group of them can still be cut between ids. The keys are never sorted to
find the cuts. Instead every round lays probes between the bounds known for each
cut, all partitions count the rows and bytes below every probe, and the bounds
close in, until each cut is within tolerance of its target or falls between two
neighbouring keys. Then the rows are exchanged once, straight to their
destination, and numbered there; the last round's exact counts give each
destination its first slot. A large shard has several destinations of about
``part_bytes``, whose cuts are found alike with a wide tolerance; the driver holds
the cuts, 32 bytes for each ``part_bytes`` of the table.

``law`` is ``bytes``: the shards' sizes are near equal (within the tolerance, or
the largest single row where that is more). A size is the text's UTF-8 bytes plus
16; a null text has no bytes. Null ids sort first. Rows with the same text and the
same id are adjacent and may be cut nowhere between them, so they share a shard. An
empty table gives no rows; a long text is never cut, and may exceed a shard's share.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import Scratch

LAW = "bytes"
ROW_BYTES = 16
#: Probes laid for each open cut in a round.
PROBES = 24
#: How far a cut may be from its target, in parts of a shard's size.
TOLERANCE = 0.0005
#: Bytes that a destination of the exchange holds, about, and probes for each of its cuts in a round.
PART_BYTES, PART_PROBES = 256 << 20, 4
_SPAN = 1 << 64


def _below(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each probe: rows and bytes below it, the greatest key below it and the least at or above it (-1: none).

    A composite key is the unsigned hash * 2^64 + the id, shifted to be unsigned.
    """
    hashes, ids = [p // _SPAN for p in probes], [p % _SPAN for p in probes]

    def run(batches):
        import numpy as np
        import pandas as pd

        at, lower = np.array(hashes, dtype=np.uint64), np.array(ids, dtype=np.uint64)
        n = len(at)
        rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        under_h, under_i, has_under = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        over_h, over_i, has_over = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        for b in batches:
            h = b["h"].to_numpy().astype(np.int64).view(np.uint64)
            i = b["id"].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            total = np.concatenate([[0], np.cumsum(b["size"].to_numpy().astype(np.int64)[order])])
            p, right = np.searchsorted(h, at, "left"), np.searchsorted(h, at, "right")
            for k in np.flatnonzero(right > p):
                p[k] += np.searchsorted(i[p[k] : right[k]], lower[k], "left")
            rows += p
            size += total[p]
            some = p > 0
            x, y = h[np.maximum(p - 1, 0)], i[np.maximum(p - 1, 0)]
            new = some & (~has_under | (x > under_h) | ((x == under_h) & (y > under_i)))
            under_h[new], under_i[new] = x[new], y[new]
            has_under |= some
            some = p < len(h)
            x, y = h[np.minimum(p, len(h) - 1)], i[np.minimum(p, len(h) - 1)]
            new = some & (~has_over | (x < over_h) | ((x == over_h) & (y < over_i)))
            over_h[new], over_i[new] = x[new], y[new]
            has_over |= some
        show = lambda has, x, y: [f"{int(u):016x}{int(v):016x}" if t else None for t, u, v in zip(has, x, y, strict=True)]
        yield pd.DataFrame({"probe": range(n), "n": rows, "s": size, "u": show(has_under, under_h, under_i), "o": show(has_over, over_h, over_i)})

    counted = keys.mapInPandas(run, "probe int, n bigint, s bigint, u string, o string")
    found = counted.groupBy("probe").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("u").alias("u"), F.min("o").alias("o")).collect()
    return {probes[r.probe]: (r.n, r.s, int(r.u, 16) if r.u else -1, int(r.o, 16) if r.o else -1) for r in found}


def find_cuts(keys: DataFrame, shares: list[float], total: int, tolerance: float, most_probes: int = PROBES) -> list[tuple[int, int]]:
    """For each share of all bytes: (composite key, rows below it), such that the bytes below it are
    nearest to the share, or within ``tolerance`` bytes of it."""
    targets = [share * total for share in shares]
    low = [(0, 0, 0)] * len(targets)  # key, rows, bytes below: not over the target
    high = [(_SPAN * _SPAN - 1, -1, total)] * len(targets)
    done: dict[int, tuple[int, int]] = {}
    while len(done) < len(targets):
        probes: set[int] = set()
        for k, t in enumerate(targets):
            if k in done:
                continue
            a, b = low[k], high[k]
            width = b[0] - a[0]
            if width <= most_probes:
                probes |= set(range(a[0], b[0] + 1))
                continue
            guess = a[0] + int(width * ((t - a[2]) / max(1, b[2] - a[2])))
            spread = width / math.sqrt(most_probes * max(4.0, (b[2] - a[2]) / max(1.0, tolerance)))
            near = [guess + int(spread * x) for x in range(-most_probes // 4, most_probes // 4 + 1)]
            even = [a[0] + width * x // (most_probes // 2) for x in range(most_probes // 2 + 1)]
            probes |= {min(max(p, a[0]), b[0]) for p in near + even}
        found = _below(keys, sorted(probes))
        points = sorted((p, n, s, u, o) for p, (n, s, u, o) in found.items())
        sizes = [x[2] for x in points]
        for k, t in enumerate(targets):
            if k in done:
                continue
            at = bisect_right(sizes, t)
            if at and points[at - 1][0] >= low[k][0]:
                # nothing lies between the probe and the next key, so the bound moves up to that key
                p, n, s, _, o = points[at - 1]
                low[k] = (max(p, o), n, s)
            if at < len(points) and points[at][0] <= high[k][0]:
                # the greatest key below has its bytes counted in s
                _, n, s, u, _ = points[at]
                high[k] = (u + 1, n, s)
            a, b = low[k], high[k]
            if t - a[2] <= tolerance:
                done[k] = (a[0], a[1])
            elif b[1] >= 0 and b[2] - t <= tolerance:
                done[k] = (b[0], b[1])
            elif b[0] - a[0] <= 1:  # a single key holds the target: cut on its nearer side
                done[k] = (a[0], a[1]) if t - a[2] <= b[2] - t or b[1] < 0 else (b[0], b[1])
    return [done[k] for k in range(len(targets))]


def _count_at_or_below(cuts: list[str], key: Column) -> Column:
    """How many of the sorted cuts are at or below the key, by halving."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    array, n = F.lit(cuts), F.lit(len(cuts))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.element_at(array, F.least(at + step, n)) <= key), at + step).otherwise(at))


def shard(docs: DataFrame, n_shards: int, id_column: str = "doc_id", text_column: str = "text", tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard (null under this law).

    Columns of the input with these names are replaced. Ids are integers.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    h, size = F.xxhash64(text), F.octet_length(text).cast("bigint") + ROW_BYTES
    key = F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(-(1 << 63)))
    scratch = Scratch(spark)
    keys = scratch.keep(docs.select(h.alias("h"), key.alias("id"), size.alias("size")))
    total, count = keys.agg(F.sum("size"), F.count("*")).first()
    parts = -(-(total or 0) // part_bytes)
    cuts = find_cuts(keys, [k / n_shards for k in range(1, n_shards)], total, tolerance * total / n_shards) if count else []
    begins = [0, *[n for _, n in cuts]]  # of each shard, in rows
    found, of = cuts, list(range(len(begins)))
    if parts > n_shards:
        inner = find_cuts(keys, [k / parts for k in range(1, parts)], total, part_bytes / 4, PART_PROBES)
        found = sorted({*cuts, *inner})
        of = [0, *[bisect_right(cuts, c) for c in found]]
    starts = [n - begins[k] for (_, n), k in zip([(0, 0), *found], of, strict=True)]
    scratch.drop()
    wide = F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    part = _count_at_or_below([f"{c:032X}" for c, _ in found], wide) if found else F.lit(0)
    made = {"size": size, "text_crc32": F.crc32(text), "law": F.lit(LAW), "_key": wide, "_part": part}
    placed = docs.drop(*{"size", "text_crc32", "law", "shard", "slot", "grown_shard"} - {id_column, text_column}).withColumns(made)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    offset = F.element_at(F.lit(starts), F.col("_part") + 1).cast("bigint")
    shard_of = F.element_at(F.lit(of), F.col("_part") + 1).cast("int")
    return placed.withColumns({"shard": shard_of, "slot": offset + rank - 1, "grown_shard": F.lit(None).cast("int")}).drop("_key", "_part")


def op5_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    from agora.llm.common import table

    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
