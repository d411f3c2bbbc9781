"""Topic models as DataFrame algebra: words, weights, representatives, merges, clusters.

Vocabulary counts are grouped by (topic, term); nothing is collected but a handful
of fitted parameters. Clustering stands in for neighbour-graph methods that can't
be reproduced natively: principal components of unit vectors, then bisecting
k-means, with small clusters as outliers. Its ids are ordered by size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import HashingTF, IDF, Normalizer, PCA, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from agora import config
from agora.config import RefineConfig, TopicConfig
from agora.functions.vectors import cosine, dot
from agora.operators.counting import hashed_sums, likeness
from agora.written import written


def stopwords(cfg_extra=config.EXTRA_STOPWORDS, keep_negations: bool = True, base: list[str] | None = None) -> list[str]:
    """Spark's English list (or another one) with the extra words, without negations."""
    words = set(base if base is not None else StopWordsRemover.loadDefaultStopWords("english")) | {w.lower() for w in cfg_extra}
    return sorted(words - set(config.NEGATIONS) if keep_negations else words)


def words(c: Column, pattern: str = r"[a-z][a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, n: int, stop: list[str] | None = None) -> Column:
    """All 1..n-grams of the tokens that are no stopwords."""
    t = tokens
    if stop:
        s = F.array(*map(F.lit, stop))
        t = F.filter(tokens, lambda x: ~F.array_contains(s, x))
    out = t
    grams, size = t, F.size(t)
    for k in range(2, n + 1):  # each k-gram from a (k-1)-gram and the token behind it
        count = F.greatest(size - k + 1, F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(t, F.lit(k), count), lambda x, y: F.concat(x, F.lit(" "), y))
        out = F.concat(out, grams)
    return out


def term_counts(df: DataFrame, topic: str, terms: Column) -> DataFrame:
    return df.select(F.col(topic).alias("topic"), F.explode(terms).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))


def vectorized(counts: DataFrame, cfg: TopicConfig) -> DataFrame:
    """Terms in at least min_df topics and in at most max_df of them, the max_features most frequent ones. With so few
    topics that no term can be within both limits, they don't apply."""
    n = counts.agg(F.count_distinct("topic")).scalar()
    df = counts.groupBy("term").agg(F.count("*").alias("_df"), F.sum("tf").alias("_tf"))
    within = (F.col("_df") >= cfg.min_df) & (F.col("_df") <= n * cfg.max_df)
    df = df.filter(within | (F.lit(cfg.min_df) > n * cfg.max_df))
    if cfg.max_features:
        df = df.orderBy(F.desc("_tf"), "term").limit(cfg.max_features)
    return counts.join(df.select("term"), "term", "left_semi")


def ctfidf(counts: DataFrame) -> DataFrame:
    """(topic, term, tf, weight): tf / words of the topic * ln(1 + mean words of a topic / frequency of the term)."""
    per_topic = F.sum("tf").over(Window.partitionBy("topic"))
    mean = counts.groupBy("topic").agg(F.sum("tf").alias("s")).agg(F.avg("s")).scalar()
    totals = counts.groupBy("term").agg(F.sum("tf").alias("_f"))
    d = counts.withColumn("_n", per_topic).join(totals, "term").withColumn("_mean", mean)
    return d.select("topic", "term", "tf", (F.col("tf") / F.col("_n") * F.log(1 + F.col("_mean") / F.col("_f"))).alias("weight"))


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights.withColumn("rank", r).filter(F.col("rank") <= n)


def topic_info(docs: DataFrame, weights: DataFrame, topic: str, text: str | None = None, n: int = 10, representatives: int = 3, key: str = "doc_id") -> DataFrame:
    """(Topic, Count, Name, Representation[, Representative_Docs]): name = topic and its first four words; the documents
    whose words are most like the topic's (cosine of counts to weights) represent it."""
    ranked = top_words(weights, n).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("Representation"))
    counts = docs.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("Count"))
    d = counts.join(ranked, "topic", "left")
    name = F.concat_ws("_", F.col("topic").cast("string"), F.slice(F.coalesce("Representation", F.array().cast("array<string>")), 1, 4))
    d = d.withColumn("Name", name)
    if text:
        # documents are ranked by their likeness to the topic's words, on ids alone; texts are fetched for the chosen ones
        named = likeness(docs, topic, key, text, top_words(weights, n), representatives)
        best = Window.partitionBy("_topic").orderBy(F.desc("_like"), "_key")
        chosen = named.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= representatives)
        chosen = written(chosen.select("_topic", "_key", "_r"))  # so their size is known, and texts needn't be exchanged for a few
        reps = docs.join(chosen, F.col(topic).eqNullSafe(F.col("_topic")) & (F.col(key) == F.col("_key")))
        reps = reps.groupBy(F.col(topic).alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))), lambda x: x["t"]).alias("Representative_Docs"))
        d = d.join(reps, "topic", "left")
    return d.withColumnRenamed("topic", "Topic")


def fallback_label(info: DataFrame, n: int = 8) -> DataFrame:
    """``topic_label_bert``: of the outlier topic a fixed text, else the name's words, else the first words, else the id."""
    name = F.regexp_replace(F.coalesce("Name", F.lit("")), r"^-?\d+_", "")
    listed = F.array_join(F.slice(F.coalesce("Representation", F.array().cast("array<string>")), 1, n), ", ")
    label = F.when(F.col("Topic") == -1, "Outlier / Mixed").when(name != "", name).when(listed != "", listed).otherwise(F.concat(F.lit("Topic "), F.col("Topic").cast("string")))
    return info.withColumn("topic_label_bert", label)


def max_probability(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def time_bins(docs: DataFrame, ts: str, nr_bins: int) -> DataFrame:
    """``bin``: 0 to nr_bins - 1, of equal width between the first and the last time (a number, a date or a timestamp)."""
    kind = dict(docs.dtypes)[ts]
    at = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(ts)
    low, high = docs.agg(F.min(at), F.max(at)).first()
    if low is None or low == high:
        return docs.withColumn("bin", F.when(F.col(ts).isNotNull(), 0))
    k = F.floor((at - F.lit(low)) * float(nr_bins) / F.lit(high - low))
    return docs.withColumn("bin", F.when(k.isNotNull(), F.least(F.lit(nr_bins - 1), k)).cast("int"))


def topics_over_time(docs: DataFrame, topic: str, time_bin: str, terms: Column, n: int = 5, global_tuning: bool = False) -> DataFrame:
    """Words of each topic in each bin: counts in the bin, weighted by the whole corpus' term frequencies. With global
    tuning a term's share in the bin is averaged with its share in the whole topic."""
    d = docs.select(F.col(topic).alias("topic"), F.col(time_bin).alias("bin"), F.explode(terms).alias("term"))
    tf = d.groupBy("topic", "bin", "term").agg(F.count("*").alias("tf"))
    whole = ctfidf(tf.groupBy("topic", "term").agg(F.sum("tf").alias("tf")))
    idf = whole.groupBy("term").agg(F.sum("tf").alias("_f"))
    mean = tf.groupBy("topic").agg(F.sum("tf").alias("s")).agg(F.avg("s")).scalar()
    per = F.sum("tf").over(Window.partitionBy("topic", "bin"))
    share = F.col("tf") / per
    w = tf.withColumn("_share", share)
    if global_tuning:
        total = F.sum("tf").over(Window.partitionBy("topic"))
        overall = whole.select("topic", "term", (F.col("tf") / total).alias("_whole"))
        w = w.join(overall, ["topic", "term"]).withColumn("_share", (F.col("_share") + F.col("_whole")) / 2)
    w = w.join(idf, "term").withColumn("_mean", mean).withColumn("weight", F.col("_share") * F.log(1 + F.col("_mean") / F.col("_f")))
    r = F.row_number().over(Window.partitionBy("topic", "bin").orderBy(F.desc(F.round("weight", 9)), "term"))
    return w.withColumn("rank", r).filter(F.col("rank") <= n).select("topic", "bin", "term", "tf", "weight", "rank")


def tfidf(counts: DataFrame) -> DataFrame:
    """(topic, term, w): tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 for each topic."""
    n = counts.agg(F.count_distinct("topic")).scalar()
    df = counts.groupBy("term").agg(F.count("*").alias("_df"))
    d = counts.join(df, "term").withColumn("_n", n).withColumn("w", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    return d.select("topic", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("topic")))).alias("w"))


def merge_pairs(weights: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """(topic_a, topic_b, similarity) over the threshold, the most similar pairs. Topics meet only in terms they share."""
    a, b = weights.select(F.col("topic").alias("topic_a"), "term", F.col("w").alias("wa")), weights.select(F.col("topic").alias("topic_b"), "term", F.col("w").alias("wb"))
    s = a.join(b, "term").filter("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    s = s.filter(F.col("similarity") >= cfg.merge_threshold).withColumn("similarity", F.round("similarity", 4))
    return s.orderBy(F.desc("similarity"), "topic_a", "topic_b").limit(cfg.merge_top_pairs)


def topic_text(info: DataFrame, columns=("topic_label_llm", "Name", "topic_keywords_clean", "topic_keybert_clean", "MMR")) -> Column:
    parts = [F.array_join(F.col(c), " ") if dict(info.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in columns if c in info.columns]
    return F.concat_ws(" ", *parts)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, component by component."""
    d = df.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x")).groupBy("g", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return d.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid")).withColumnRenamed("g", group)


def distances(df: DataFrame, group: str, vector: str) -> DataFrame:
    """1 - cosine of each row to its group's mean."""
    c = centroids(df, group, vector).withColumnRenamed(group, "_g")
    return df.join(c, F.col(group).eqNullSafe(F.col("_g"))).withColumn("distance", 1 - cosine(F.col(vector), F.col("centroid"))).drop("_g", "centroid")


def centroid_farthest(df: DataFrame, group: str, vector: str, value: str, position: str) -> DataFrame:
    """The rows nearest to and farthest from their group's mean, ties to the first position."""
    d = distances(df, group, vector).withColumn("_d", F.round("distance", 9))
    near = F.min(F.struct("_d", position, value))[value]
    far = F.min(F.struct(-F.col("_d"), F.col(position), F.col(value)))[value]
    return d.groupBy(group).agg(near.alias("rep_doc_centroid"), far.alias("rep_doc_farthest"))


def embedder(docs: DataFrame, text: str, size: int = 256) -> Callable[[DataFrame, str], DataFrame]:
    """A function of (rows, text column) that adds ``embedding``: hashed TF-IDF, with the document frequencies of ``docs``."""
    from pyspark.ml.functions import vector_to_array

    def hashed(df: DataFrame, column: str) -> DataFrame:
        d = df.withColumn("_tokens", words(F.coalesce(F.col(column), F.lit(""))))
        return HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_tf").transform(d)

    model = IDF(inputCol="_tf", outputCol="_e").fit(hashed(docs, text))
    return lambda df, column: model.transform(hashed(df, column)).withColumn("embedding", vector_to_array("_e", "float32")).drop("_tokens", "_tf", "_e")


def embed(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """``embedding``: hashed TF-IDF of the text, the offline default of a pluggable embedder."""
    return embedder(df, text, size)(df, text)


def embed_with(df: DataFrame, text: str, model, batch: int = 128) -> DataFrame:
    """``embedding`` by any callable from a list of texts to vectors, in Arrow batches."""
    schema = P.StructType([*df.schema.fields, P.StructField("embedding", P.ArrayType(P.FloatType()))])

    def run(frames):
        for f in frames:
            vectors = []
            for k in range(0, len(f), batch):
                vectors += [list(map(float, v)) for v in model(f[text].iloc[k : k + batch].fillna("").tolist())]
            f["embedding"] = vectors
            yield f

    return df.mapInPandas(run, schema)


def cluster(df: DataFrame, vector: str, cfg: TopicConfig = TopicConfig(), k: int = 8) -> DataFrame:
    """``topic`` (by falling size from 0; -1 for clusters below the least size) and ``topic_probability_max``."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = Normalizer(inputCol="_v", outputCol="_u").transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    d = PCA(k=cfg.components, inputCol="_u", outputCol="_p").fit(d).transform(d)
    model = BisectingKMeans(k=cfg.nr_topics or k, seed=cfg.seed, featuresCol="_p", predictionCol="_c").fit(d)
    d = model.transform(d)
    centers = d.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_c int, _m array<double>")
    sizes = d.groupBy("_c").count()
    order = F.row_number().over(Window.orderBy(F.desc("count"), "_c")) - 1
    names = sizes.filter(F.col("count") >= cfg.min_cluster_size).withColumn("topic", order).select("_c", "topic")
    d = d.join(F.broadcast(names), "_c", "left").join(F.broadcast(centers), "_c").withColumn("_a", vector_to_array("_p"))
    diff = F.zip_with("_a", "_m", lambda x, y: x - y)
    return d.withColumns({"topic": F.coalesce("topic", F.lit(-1)), "topic_probability_max": 1 / (1 + F.sqrt(dot(diff, diff)))}).drop("_c", "_v", "_u", "_p", "_m", "_a")


def hierarchy(weights: DataFrame) -> list[tuple[int, int, int, float]]:
    """Average-linkage merges (new id, left, right, similarity) of topics by their term weights. Pairs of topics,
    a few hundred at most, are merged on the driver; their similarities are computed by the cluster."""
    topics = sorted(r[0] for r in weights.select("topic").distinct().collect())
    sim = {(r.topic_a, r.topic_b): r.similarity for r in merge_pairs(weights, RefineConfig(merge_threshold=0.0, merge_top_pairs=len(topics) ** 2)).collect()}
    groups = {k: [t] for k, t in enumerate(topics)}
    out, new = [], len(topics)
    mean = lambda a, b: sum(sim.get((min(x, y), max(x, y)), 0.0) for x in groups[a] for y in groups[b]) / (len(groups[a]) * len(groups[b]))
    while len(groups) > 1:
        s, a, b = max(((mean(a, b), -a, -b) for a in groups for b in groups if a < b))
        a, b = -a, -b
        out.append((new, a, b, float(s)))
        groups[new] = groups.pop(a) + groups.pop(b)
        new += 1
    return out


def reduce_topics(weights: DataFrame, nr_topics: int | str, least: float = RefineConfig.merge_threshold) -> DataFrame:
    """(topic, reduced): topics merged, most similar first, until nr_topics are left, or with "auto" while groups are at
    least as similar as ``least``; a group is named by its least topic."""
    topics = sorted(r[0] for r in weights.select("topic").distinct().collect())
    groups = {k: [t] for k, t in enumerate(topics)}
    for new, a, b, similarity in hierarchy(weights):
        if similarity < least if nr_topics == "auto" else len(groups) <= max(1, nr_topics):
            break
        groups[new] = groups.pop(a) + groups.pop(b)
    rows = [(t, min(g)) for g in groups.values() for t in g]
    return weights.sparkSession.createDataFrame(rows, weights.select(F.col("topic"), F.col("topic").alias("reduced")).schema)


def document_info(docs: DataFrame, info: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents with their topic's name and words, and whether they represent it."""
    i = info.withColumnRenamed("Topic", "_T")
    d = docs.join(i, F.col(topic).eqNullSafe(F.col("_T")), "left").drop("_T")
    if "Representative_Docs" in info.columns and "text" in docs.columns:
        d = d.withColumn("representative", F.coalesce(F.array_contains("Representative_Docs", F.col("text")), F.lit(False))).drop("Representative_Docs")
    return d


def keyterms(weights: DataFrame, similarity: DataFrame, n: int = 10) -> DataFrame:
    """Candidate terms of each topic ranked by ``sim`` (their similarity to its centroid), from (topic, term, sim)."""
    d = top_words(weights, 3 * n).drop("rank").join(similarity, ["topic", "term"])
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("sim", 9)), "term"))
    return d.withColumn("rank", r).filter(F.col("rank") <= n)


def term_similarity(vectors: DataFrame, topic: str, weights: DataFrame, embed: Callable[[DataFrame, str], DataFrame], n: int = 10) -> DataFrame:
    """(topic, term, sim): cosine of each topic's candidates to the mean ``embedding`` of its documents. ``embed`` adds the
    terms' ``embedding`` in the documents' space."""
    return _to_centroids(centroids(vectors, topic, "embedding").withColumnRenamed(topic, "_g"), weights, embed, n)


def _to_centroids(means: DataFrame, weights: DataFrame, embed: Callable[[DataFrame, str], DataFrame], n: int) -> DataFrame:
    candidates = top_words(weights, 3 * n).select("topic", "term")
    terms = embed(candidates.select("term").distinct(), "term").select("term", "embedding")
    d = candidates.join(terms, "term").join(means, F.col("topic").eqNullSafe(F.col("_g")))
    return d.select("topic", "term", cosine(F.col("embedding"), F.col("centroid")).alias("sim"))


def hashed_similarity(docs: DataFrame, topic: str, text: str, weights: DataFrame, n: int = 10, size: int = 256, sums: DataFrame | None = None) -> DataFrame:
    """``term_similarity`` in the space of ``embed``. The mean of hashed TF-IDF vectors follows from a topic's sums, so
    no document is embedded; sums are doubles, where ``embed`` rounds each vector to floats."""
    sums = written(sums or hashed_sums(docs, topic, text, size))
    rows = docs.groupBy(F.col(topic).alias("_g")).agg(F.count("*").alias("_n"))
    total = docs.count()
    df = dict(sums.groupBy("i").agg(F.sum("df")).collect())
    idf = F.array(*[F.lit(math.log((total + 1) / (df.get(i, 0) + 1))) for i in range(size)])
    means = sums.groupBy(F.col("topic").alias("_t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "tf"))), lambda x: x["tf"]).alias("_tf")).join(rows, F.col("_t").eqNullSafe(F.col("_g")))
    means = means.select("_g", F.zip_with("_tf", idf, lambda x, w: x * w / F.col("_n")).alias("centroid"))

    def embed_terms(d: DataFrame, column: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        d = HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_v").transform(d.withColumn("_tokens", words(F.col(column))))
        return d.withColumn("embedding", F.zip_with(vector_to_array("_v"), idf, lambda x, w: (x * w).cast("float")))

    return _to_centroids(means, weights, embed_terms, n)


def keybert(weights: DataFrame, similarity: DataFrame, n: int = 10) -> DataFrame:
    """(topic, KeyBERT): the terms of ``keyterms`` in their order."""
    d = keyterms(weights, similarity, n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_k"))
    return d.select("topic", F.transform("_k", lambda x: x["term"]).alias("KeyBERT"))


def mmr(weights: DataFrame, n: int = 10, diversity: float = 0.3, candidates: int = 30) -> DataFrame:
    """Maximal marginal relevance of each topic's terms: relevance is the weight over the topic's greatest, likeness of
    two terms is that of their character trigrams. A fold over an array of candidates, bounded by ``candidates``."""
    top = top_words(weights, candidates)
    rel = F.col("weight") / F.max("weight").over(Window.partitionBy("topic"))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    g = top.withColumns({"rel": rel}).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "rel"))).alias("c"))
    like = lambda a, b: F.size(F.array_intersect(grams(a), grams(b))) / F.size(F.array_union(grams(a), grams(b)))

    def step(kept, _):
        worth = lambda x: (1 - diversity) * x["rel"] - diversity * F.coalesce(F.array_max(F.transform(kept, lambda k: like(k, x["term"]))), F.lit(0.0))
        left = F.filter(F.col("c"), lambda x: ~F.array_contains(kept, x["term"]))
        best = F.array_max(F.transform(left, lambda x: F.struct(F.round(worth(x), 9).alias("w"), (-x["rank"]).alias("r"), x["term"].alias("t"))))
        return F.when(F.size(left) > 0, F.concat(kept, F.array(best["t"]))).otherwise(kept)

    return g.select("topic", F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<string>"), step).alias("MMR"))
