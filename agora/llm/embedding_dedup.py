"""Near-duplicate embeddings by an epsilon grid order join.

Two vectors of one label link when their cosine, in double precision, is at least
``least``; of unit vectors that is a distance of at most eps = sqrt(2 - 2 least).

Directions are turned onto principal axes fitted on a bounded sample. The first
few axes cut space into cells of ``CELL`` eps; a vector lives in one cell and
visits the cells in front of its own (in lexicographic order) that lie within eps
of it. Each cell is a join of its own: of its rows with each other and with its
visitors. Within, rows are sorted by grid cells of width eps on the leading axes,
and intervals of that sequence are joined recursively: pairs of intervals whose
boxes are further apart than eps are skipped, pairs that lie together within eps
are linked as a whole, the rest is halved until small blocks are multiplied.
Crowded cells are cut into blocks of ``BLOCK_ROWS``, and equal vectors are joined
once, with their number.

A join returns, for each row, how many it links with and the least id it is
connected with there, never the pairs; ``components`` joins those up.

Vectors that are null, empty or zero, or hold null or non-finite components, and
those with a null label, link with nothing and are kept. Vectors of different
lengths never link. Rows with the same id are one node with the links of all of
them: such a row's links count rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import Scratch
from agora.llm.components import components
from agora.llm.vectors import doubles, matrix, units, usable

SAMPLE_ROWS = 4_096
#: Rows of a block of a crowded cell, and of a block that is multiplied.
BLOCK_ROWS, SMALL = 4_096, 192
#: Cell width in eps; axes that cells are cut on at most; axes of the grid order and of the boxes.
CELL, MOST_CELL_AXES, ORDER_AXES, BOX_AXES = 3.0, 8, 8, 16


def principal_axes(sample, size: int):
    """The sample's principal axes, by falling variance, as columns."""
    import numpy as np

    u = units(sample) if len(sample) else np.zeros((0, size))
    centred = u - u.mean(axis=0) if len(u) else u
    _, vectors = np.linalg.eigh(centred.T @ centred if len(u) else np.eye(size))
    return vectors[:, ::-1]


def cells_of(y, axes: int, eps: float):
    """(row, cell, home?) for the home cell of each row and the cells in front within eps of it."""
    import numpy as np

    width = CELL * eps
    home = np.floor(y[:, :axes] / width).astype(np.int64)
    inside = y[:, :axes] - home * width
    row, offset, used = np.arange(len(y)), np.zeros((len(y), axes), np.int64), np.zeros(len(y))
    for f in range(axes):  # extend by each axis: stay, go down or go up if still within eps
        parts = [(row, offset, used)]
        for step, gap in ((-1, inside[row, f]), (1, width - inside[row, f])):
            ok = used + gap**2 <= (eps * (1 + 1e-9)) ** 2
            moved = offset[ok].copy()
            moved[:, f] = step
            parts.append((row[ok], moved, used[ok] + gap[ok] ** 2))
        row, offset, used = (np.concatenate([p[k] for p in parts]) for k in range(3))
    first = np.where((offset != 0).any(axis=1), np.take_along_axis(offset, (offset != 0).argmax(axis=1)[:, None], 1)[:, 0], 0)
    keep = first >= 0
    return row[keep], home[row[keep]] + offset[keep], first[keep] == 0


class Join:
    """The rows of one join; counts of links and connections within it."""

    def __init__(self, ids, many, x, axes, least: float):
        import numpy as np

        self.least, self.eps = least, math.sqrt(2 - 2 * least)
        u = units(x)
        y = u @ axes
        grid = np.floor(y[:, :ORDER_AXES] / self.eps).astype(np.int64)
        self.order = np.lexsort(grid.T[::-1])
        self.ids, self.many, self.x, self.u, self.y = ids[self.order], many[self.order], x[self.order], u[self.order], y[self.order][:, :BOX_AXES]
        self.links = np.zeros(len(ids), np.int64)
        self.parent = np.arange(len(ids))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return int(k)

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def boxes(self, rows):
        """(low, high, centre, radius) of an interval."""
        import numpy as np

        y, centre = self.y[rows], self.u[rows].mean(axis=0)
        return y.min(axis=0), y.max(axis=0), centre, float(np.sqrt(((self.u[rows] - centre) ** 2).sum(axis=1).max()))

    def join(self, a, b, same: bool, box_a=None, box_b=None) -> None:
        """Links between the rows a and b (positions, each ascending); ``same``: a is b."""
        import numpy as np

        if not len(a) or not len(b):
            return
        box_a = box_a or self.boxes(a)
        box_b = box_a if same else box_b or self.boxes(b)
        gap = np.maximum(np.maximum(box_a[0] - box_b[1], box_b[0] - box_a[1]), 0.0)
        if (gap**2).sum() > self.eps**2 * (1 + 1e-9):
            return
        if np.sqrt(((box_a[2] - box_b[2]) ** 2).sum()) + box_a[3] + box_b[3] <= self.eps * (1 - 1e-9):
            self.links[a] += self.many[b].sum() - (self.many[a] if same else 0)
            if not same:
                self.links[b] += self.many[a].sum()
            for k in np.concatenate([a, b]):
                self.union(int(a[0]), int(k))
            return
        if len(a) <= SMALL and len(b) <= SMALL:
            self.multiply(a, b, same)
        elif same:
            half = len(a) // 2
            left, right = a[:half], a[half:]
            x, y = self.boxes(left), self.boxes(right)
            self.join(left, left, True, x, x)
            self.join(left, right, False, x, y)
            self.join(right, right, True, y, y)
        elif len(a) >= len(b):
            half = len(a) // 2
            self.join(a[:half], b, False, None, box_b)
            self.join(a[half:], b, False, None, box_b)
        else:
            half = len(b) // 2
            self.join(a, b[:half], False, box_a, None)
            self.join(a, b[half:], False, box_a, None)

    def multiply(self, a, b, same: bool) -> None:
        import numpy as np

        s = self.u[a] @ self.u[b].T
        linked = s >= self.least
        for i, j in zip(*np.nonzero(np.abs(s - self.least) < 1e-9), strict=True):  # near the limit: from the original values
            p, q = self.x[a[i]], self.x[b[j]]
            linked[i, j] = float(np.dot(p, q) / (np.sqrt(np.dot(p, p)) * np.sqrt(np.dot(q, q)))) >= self.least
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.links[a] += linked @ self.many[b]
        if not same:
            self.links[b] += linked.T @ self.many[a]
        la, lb = np.array([self.find(int(k)) for k in a]), np.array([self.find(int(k)) for k in b])
        old_a, old_b, none = la.copy(), lb.copy(), len(self.parent)
        while True:
            na = np.minimum(la, np.where(linked, lb[None, :], none).min(axis=1))
            nb = np.minimum(lb, np.where(linked, na[:, None], none).min(axis=0))
            if same:
                na = nb = np.minimum(na, nb)
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        for old, new in ((old_a, la), (old_b, lb)):
            for k in np.flatnonzero(old != new):
                self.union(int(old[k]), int(new[k]))

    def roots(self):
        """For each row the least id that it is connected with here."""
        import numpy as np

        root = np.array([self.find(k) for k in range(len(self.ids))])
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, self.ids)
        return least[root]


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept)."""
    import numpy as np

    spark = vectors.sparkSession
    scratch = Scratch(spark)
    eps = math.sqrt(2 - 2 * least)
    every = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{label_column}`").cast("string").alias("label"), doubles(vectors, vector_column).alias("v"))
    part = F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("v"))
    rows = every.filter(part)
    distinct = scratch.keep(rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("many")))
    facts = distinct.agg(F.count("*"), F.count_distinct("label"), F.max(F.size("v")), F.min(F.size("v"))).first()
    n, labels, size = facts[0], facts[1], facts[2] or 1
    # vectors of other lengths than the longest are padded with zeros only for the axes; lengths are part of the cell
    sample = [r.v for r in distinct.filter(F.size("v") == size).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()]
    axes = principal_axes(np.array(sample, float).reshape(-1, size), size)
    n_axes = min(MOST_CELL_AXES, size, max(2, math.ceil(math.log2(max(1.0, n / max(1, labels) / BLOCK_ROWS)))))

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            t = pa.Table.from_batches([batch])
            lengths = np.diff(batch.column(batch.schema.get_field_index("v")).offsets.to_numpy())
            for d in np.unique(lengths):
                some = t.take(pa.array(np.flatnonzero(lengths == d)))
                x = matrix(some["v"].combine_chunks())
                row, cell, home = cells_of(units(x) @ axes[:d], min(n_axes, axes.shape[1]), eps)
                taken = some.take(pa.array(row))
                names = pa.array([f"{d}:" + ",".join(map(str, c)) for c in cell], pa.string())
                out = pa.table({"label": taken["label"].combine_chunks(), "cell": names, "home": pa.array(home), "id": taken["id"].combine_chunks(), "many": taken["many"].combine_chunks(), "v": taken["v"].combine_chunks()})
                yield from out.to_batches()

    placed = distinct.select("label", "id", "many", "v").mapInArrow(spread, "label string, cell string, home boolean, id bigint, many bigint, v array<double>")
    placed = scratch.keep(placed)
    crowd = placed.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK_ROWS).cast("int").alias("nh"), F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK_ROWS).cast("int").alias("nv")
    )
    blocks = placed.join(crowd.filter("nh > 0"), ["label", "cell"])
    count = F.when(F.col("home"), F.col("nh")).otherwise(F.col("nv"))
    blocks = blocks.withColumn("s", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    keyed = blocks.select(
        "label", "cell", "id", "many", "v",
        F.when(F.col("home"), F.least("s", "t")).otherwise(-1 - F.col("s")).alias("i"),
        F.when(F.col("home"), F.greatest("s", "t")).otherwise(F.col("t")).alias("j"),
        F.when(F.col("home"), F.col("s")).otherwise(-1 - F.col("s")).alias("own"),
    )
    # a cell's rows also meet each block of its visitors
    meets = blocks.filter(F.col("home") & (F.col("t") == F.col("s")) & (F.col("nv") > 0)).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    keyed = keyed.unionByName(meets.select("label", "cell", "id", "many", "v", (-1 - F.col("u")).alias("i"), F.col("s").alias("j"), F.col("s").alias("own")))

    def join(table):
        import pyarrow as pa

        i, j, own = table["i"][0].as_py(), table["j"][0].as_py(), table["own"].to_numpy()
        x = matrix(table["v"].combine_chunks())
        work = Join(table["id"].to_numpy(), table["many"].to_numpy(), x, axes[: x.shape[1]], least)
        own = own[work.order]
        if i == j:
            k = np.arange(len(own))
            work.join(k, k, True)
        else:
            work.join(np.flatnonzero(own == i), np.flatnonzero(own == j), False)
        return pa.table({"id": pa.array(work.ids, pa.int64()), "links": pa.array(work.links, pa.int64()), "root": pa.array(work.roots(), pa.int64())})

    found = keyed.groupBy("label", "cell", "i", "j").applyInArrow(join, "id bigint, links bigint, root bigint").filter("links > 0")
    found = scratch.keep(found)
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # representatives of equal vectors are unique by (label, v); ids needn't be
    known = distinct.select(F.col("label").alias("_l"), F.col("v").alias("_v"), F.col("id").alias("rep"), "many")
    out = every.join(known, part & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left").drop("_l", "_v", "v", "label")
    out = out.join(links.withColumnRenamed("id", "_a"), F.col("rep") == F.col("_a"), "left").join(linked.withColumnRenamed("id", "_b"), F.col("rep") == F.col("_b"), "left")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("many"), F.lit(1)) - 1
    component = F.coalesce("component", "rep", "id")
    final = Scratch(spark).keep(out.select("id", n_links.cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")), last=True)
    scratch.drop()
    return final.withColumnRenamed("id", id_column)


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.98 within labels."""
    from agora.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
