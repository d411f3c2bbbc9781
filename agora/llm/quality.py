"""Document quality by hierarchical empirical Bayes.

A logistic classifier over a few ratios of the text gives each document the
probability that it is good. Hosts and the paths below them (here a document's
source, and its language there) get posteriors of their own: their documents'
mean probability, shrunk toward the level above by as many pseudo-documents as
the spread between groups supports (method of moments, one aggregation of the
group table). Sparse groups stay near their parent, and hosts near the global
mean. The path's shift against the global mean joins the document's own evidence
as log-odds.

Only per-group counts and sums are shuffled, after partial aggregation, so a host
with a third of all documents costs no task more than another. The group table is
broadcast after its size is checked, and joined by shuffle beyond that.

Null texts count as empty; an empty text has only the length feature. Null hosts
or paths are groups of their own. Repeated rows are kept and count as often as
they occur. The classifier reads at most ``most`` labelled rows, those with the
smallest hash of their id; with labels of one kind only, or none, it gives every
document that kind's probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.bpe import slices
from agora.llm.common import forget, trimmed
from agora.written import written

MOST_ROWS = 12_000
#: Documents with a smaller final probability are rejected.
THRESHOLD = 0.4
#: How much of a path's shift joins a document's log-odds.
SITE_SHARE = 0.5
#: Groups up to this many are broadcast (each under 200 bytes).
MOST_BROADCAST = 200_000
SIGNS = "#$%&*|!<>{}[]\\^~=+_@"
FEATURES = ("length", "signs", "capitals", "word_length", "distinct", "repeats", "digits", "one_sign", "long_words", "letters_end")


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text) - text.count(" ") - text.count("\n")
    signs = sum(map(text.count, SIGNS))
    previous = None
    repeats = 0
    for w in words:
        if w == previous:
            repeats += 1
        previous = w
    return [
        math.log1p(n),
        signs / chars if chars else 0.0,
        sum(map(str.isupper, words)) / n,
        min(chars / n, 40.0),
        len(set(words)) / n,
        repeats / n,
        sum(map(text.count, "0123456789")) / chars if chars else 0.0,
        words.count("|") / n,
        sum(len(w) > 30 for w in words) / n,
        sum(map(str.isalpha, [w[-1] for w in words])) / n,
    ]


@dataclass(frozen=True)
class Classifier:
    """Log-odds = bias + weights * (squared and plain features, each less its centre, over its scale)."""

    bias: float
    weights: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()

    def log_odds(self, rows):
        import numpy as np

        if not self.weights:
            return np.full(len(rows), self.bias)
        x = (widened(rows) - np.array(self.centre)) / np.array(self.scale)
        return np.clip(self.bias + np.clip(x, -20, 20) @ np.array(self.weights), -12, 12)


def widened(rows):
    """The features, their square roots, and whether they are over 0."""
    import numpy as np

    x = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
    return np.hstack([x, np.sqrt(x), x > 0.02])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_column: str = "doc_id", label_column: str = "quality") -> Classifier:
    import numpy as np

    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most)
    # the sample's size is bounded by ``most``: small ids and labels only
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "id")

    @trimmed
    def run(batches):
        import pandas as pd

        forget()
        for b in batches:
            yield pd.DataFrame({"x": [features(t) for t in b["text"]], "y": b["y"]})

    got = rows.mapInPandas(run, "x array<double>, y int").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Classifier(float(np.log(share / (1 - share))))
    x = widened(list(got["x"]))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -20, 20)])
    w, penalty = np.zeros(z.shape[1]), 1.0
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-7:
            break
    return Classifier(float(w[0]), tuple(map(float, w[1:])), tuple(map(float, centre)), tuple(map(float, scale)))


def with_log_odds(docs: DataFrame, classifier: Classifier, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with the classifier's ``_log_odds``; a text that is kept travels once."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = source.withColumn("_log_odds", F.lit(0.0)).schema
    if text_column not in keep:
        source = docs.select(*[F.col(f"`{c}`") for c in [*keep, text_column]])
    at = source.columns.index(text_column)

    @trimmed
    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            rows = [features(t or "") for _, _, texts in slices(batch.column(at)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(classifier.log_odds(rows), pa.float64())], names=[*keep, "_log_odds"])

    return source.mapInArrow(run, schema)


def probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def log_odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: str, parent: str) -> float:
    """Pseudo-documents of the parent: from the spread of group means about it, over what sampling explains."""
    r = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col(mean) - F.col(parent), 2)).alias("spread"),
        F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("binomial"),
    ).first()
    if not r.n or r.k < 2:
        return 1000.0
    noise = r.within / max(1.0, r.n - r.k)
    between = max((r.spread - (r.k - 1) * noise) / r.n, 1e-6)
    return min(10_000.0, max(1.0, (r.binomial / r.n) / between - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """From (host, path, _log_odds): the table (host, path, n, host_posterior, path_posterior) and the global mean."""
    p = probability(F.col("_log_odds"))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("s2"))
    paths = written(paths)  # read several times, and texts are costly to score
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total.s / total.n if total.n else 0.5
    hosts = hosts.withColumns({"mean": F.col("s") / F.col("n"), "parent": F.lit(float(overall))})
    k = _strength(hosts, "mean", "parent")
    hosts = hosts.select("host", ((F.col("s") + k * F.col("parent")) / (F.col("n") + k)).alias("host_posterior"))
    joined = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.*", "host_posterior")
    joined = joined.withColumn("mean", F.col("s") / F.col("n"))
    k = _strength(joined, "mean", "host_posterior")
    return joined.select("host", "path", "n", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), overall


def assess(docs: DataFrame, classifier: Classifier, host_column: str = "source", path_column: str = "lang", text_column: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` (all by default) with document_probability, host_posterior, path_posterior,
    quality (the joined probability) and rejected. Input columns of these names are replaced."""
    made = ("document_probability", "host_posterior", "path_posterior", "quality", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    host, path = F.col(f"`{host_column}`").cast("string"), F.col(f"`{path_column}`").cast("string")
    narrow = docs.select(host.alias("host"), path.alias("path"), F.col(f"`{text_column}`").alias("text"))
    sites, overall = site_posteriors(with_log_odds(narrow, classifier, keep=["host", "path"]))
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_posterior", "path_posterior")
    if sites.count() <= MOST_BROADCAST:
        sites = F.broadcast(sites)
    scored = with_log_odds(docs.withColumns({"_h": host, "_p": path}), classifier, text_column, [*keep, "_h", "_p"])
    own = F.col("_log_odds")
    final = probability(own + SITE_SHARE * (log_odds(F.col("path_posterior")) - log_odds(F.lit(overall))))
    joined = scored.join(sites, F.col("_h").eqNullSafe(F.col("_host")) & F.col("_p").eqNullSafe(F.col("_path")), "left")
    return joined.withColumns({"document_probability": probability(own), "quality": final, "rejected": final < threshold}).select(*[F.col(f"`{c}`") for c in keep], *made)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels, with source and source-and-language posteriors."""
    from agora.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = assess(docs, learn(docs, labels), keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", "document_probability", "host_posterior", "path_posterior", "quality", "rejected")
