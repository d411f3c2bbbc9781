"""Exploration tables over documents with topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.config import RefineConfig

OUTLIER = -1


def working_label(info: DataFrame) -> DataFrame:
    """``topic_label_llm``: it, else the refined label, else the model's, else empty. Key and count columns of
    either naming (Topic/topic_id, Count/doc_count) are accepted."""
    for old, new in (("topic_id", "Topic"), ("doc_count", "Count")):
        if new not in info.columns and old in info.columns:
            info = info.withColumnRenamed(old, new)
    if "topic_label_llm" in info.columns:
        return info
    for c in ("topic_label_refined", "topic_label_bert"):
        if c in info.columns:
            return info.withColumn("topic_label_llm", F.col(c))
    return info.withColumn("topic_label_llm", F.lit(""))


def prepare(docs: DataFrame, cfg: RefineConfig = RefineConfig(), groups: dict[str, str] | None = None) -> DataFrame:
    """Numbers as numbers, the year where it is missing, confident rows, and the group's mapped name (else ``other``)."""
    d = docs
    for c in ("score", "n_tokens", "topic_probability_max"):
        if c in d.columns:
            d = d.withColumn(c, F.col(c).try_cast("double"))
    if "created_year" not in d.columns:
        d = d.withColumn("created_year", F.year("created_dt"))
    if cfg.confidence_threshold is not None and "topic_probability_max" in d.columns:
        d = d.filter(F.col("topic_probability_max").isNull() | (F.col("topic_probability_max") >= cfg.confidence_threshold))
    if groups:
        lookup = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
        d = d.withColumn("subreddit_group", F.coalesce(lookup[F.col("subreddit")], F.lit("other")))
    return d


def attach(docs: DataFrame, info: DataFrame) -> DataFrame:
    """Documents with their topic's label and words; null topics meet null topics. Topic tables have a row for
    each topic: Spark broadcasts one below its own threshold, and shuffles a larger one."""
    right = [c for c in ("topic_label_llm", "topic_label_refined", "topic_label_bert", "topic_keywords_clean", "topic_keybert_clean", "Count") if c in info.columns and c not in docs.columns]
    info = info.select(F.col("Topic").alias("_Topic"), *right)
    return docs.join(info, F.col("topic").eqNullSafe(F.col("_Topic")), "left").drop("_Topic")


def in_topics(df: DataFrame, cfg: RefineConfig) -> DataFrame:
    return df.filter(~F.col("topic").eqNullSafe(F.lit(OUTLIER))) if cfg.exclude_outliers else df


def share_within(value: Column, *keys: str) -> Column:
    """The part of the group's sum; null for rows with a null key."""
    share = value / F.sum(value).over(Window.partitionBy(*keys))
    for k in keys:
        share = F.when(F.col(k).isNotNull(), share)
    return share


def prevalence(docs: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Counts by topic and their share of all. The window sums groups, not documents."""
    g = in_topics(docs, cfg).groupBy("topic", "topic_label_llm").agg(F.count("*").alias("doc_count"))
    return g.withColumn("share", share_within(F.col("doc_count")))


def trends(docs: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    g = in_topics(docs, cfg).groupBy("created_year", "topic", "topic_label_llm").agg(F.count("*").alias("count"))
    return g.withColumn("share_within_year", share_within(F.col("count"), "created_year"))


def top_topics(docs: DataFrame, n: int, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    return prevalence(docs, cfg).orderBy(F.desc("doc_count"), "topic").limit(n)


def top_trends(docs: DataFrame, n: int = 10, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Trends of the n most frequent topics."""
    t, top = trends(docs, cfg), top_topics(docs, n, cfg).select(F.col("topic").alias("_t"), F.col("topic_label_llm").alias("_l"))
    return t.join(F.broadcast(top), F.col("topic").eqNullSafe(F.col("_t")) & F.col("topic_label_llm").eqNullSafe(F.col("_l")), "left_semi")


def group_difference(docs: DataFrame, level: str = "subreddit", cfg: RefineConfig = RefineConfig()) -> DataFrame:
    if level not in docs.columns:
        raise ValueError(f"no column {level}")
    g = in_topics(docs, cfg).groupBy(level, "topic", "topic_label_llm").agg(F.count("*").alias("count"))
    return g.withColumn("share_within_group", share_within(F.col("count"), level))


def engagement(docs: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    tokens = F.avg("n_tokens") if "n_tokens" in docs.columns else F.count("*").cast("double")
    g = in_topics(docs, cfg).groupBy("topic", "topic_label_llm").agg(
        F.count("*").alias("doc_count"), F.avg("score").alias("avg_score"), F.median("score").alias("median_score"), F.percentile("score", 0.75).alias("p75_score"), tokens.alias("avg_tokens")
    )
    return g.filter(F.col("doc_count") >= cfg.min_docs)


METRICS = ("count", "mean", "median", "p25", "p75", "min", "max")


def confidence_summary(docs: DataFrame) -> DataFrame:
    """(metric, value) of the topic probability; empty if there is none."""
    spark = docs.sparkSession
    if "topic_probability_max" not in docs.columns:
        return spark.createDataFrame([], "metric string, value double")
    p = F.col("topic_probability_max")
    wide = docs.agg(
        F.count(p).cast("double").alias("count"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.percentile(p, 0.25).alias("p25"), F.percentile(p, 0.75).alias("p75"), F.min(p).alias("min"), F.max(p).alias("max")
    ).filter(F.col("count") > 0)
    return wide.unpivot([], list(METRICS), "metric", "value")


def outlier_share(docs: DataFrame) -> DataFrame:
    g = docs.filter("created_year IS NOT NULL").groupBy("created_year").agg(F.count("*").alias("doc_count"), F.count_if(F.col("topic") == OUTLIER).alias("outlier_count"))
    return g.withColumn("outlier_share", F.col("outlier_count") / F.col("doc_count"))


def yearly_stats(docs: DataFrame, by_tag: bool = True) -> DataFrame:
    keys = ["source_tag"] * by_tag + ["created_year"]
    return docs.groupBy(*keys).agg(
        F.count("doc_id").alias("doc_count"), F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("unique_topics"),
        F.count_if("is_submission").alias("submissions"), F.count_if(~F.col("is_submission")).alias("comments"),
    )


def summary_counts(df: DataFrame) -> DataFrame:
    """(n_rows, source_tags, n_topics): rows, the sorted distinct source tags, and distinct topics without outliers."""
    return df.agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("source_tag")).alias("source_tags"), F.count_distinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("n_topics"))


def heatmap(docs: DataFrame, groups: list[str] | None = None, n: int = 10, level: str = "subreddit", cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """Shares within group of the n most frequent topics: a row for each topic, a column for each given group, 0 where none.
    Without ``groups``, every group that has one of the topics is a column; rows of a null group have none."""
    top = top_topics(docs, n, cfg).select(F.col("topic_label_llm").alias("_l"))
    d = group_difference(docs, level, cfg).join(F.broadcast(top), F.col("topic_label_llm").eqNullSafe(F.col("_l")), "left_semi")
    if groups is None:
        groups = sorted(r[0] for r in d.select(level).distinct().collect() if r[0] is not None)
    return d.groupBy("topic_label_llm").pivot(level, groups).agg(F.avg("share_within_group")).fillna(0.0)


def histogram(docs: DataFrame, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts of the topic probability in equal bins; the last one holds its upper end."""
    p = docs.filter("topic_probability_max IS NOT NULL")
    b = F.least(F.width_bucket("topic_probability_max", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return p.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def all_tables(docs: DataFrame, cfg: RefineConfig = RefineConfig(), merges: DataFrame | None = None) -> dict[str, DataFrame]:
    """The exploration tables by name. Persist ``docs`` first: each reads it."""
    out = {"topic_prevalence": prevalence(docs, cfg), "topic_trends": trends(docs, cfg), "subreddit_difference": group_difference(docs, "subreddit", cfg), "engagement": engagement(docs, cfg), "confidence_summary": confidence_summary(docs), "outlier_share_by_year": outlier_share(docs)}
    return out | ({"merge_recommendations": merges} if merges is not None else {})
