"""The stages end to end: extract, reload, refine and label, explore, funnel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.config import CorpusConfig, LabelerConfig, RefineConfig, TopicConfig
from agora.functions.dates import detect
from agora.operators import canonical, explore, figures, funnel, labeling, refine, topics
from agora.sources import forum


def documents(spark: SparkSession, folder: str, tags=None, targets=None, mode: str = "all", cfg: CorpusConfig = CorpusConfig()) -> tuple[DataFrame, DataFrame]:
    """(canonical documents, filter statistics) from a folder of CSV files. Dates are detected per group."""
    raw = forum.gather(spark, folder, tags, targets, mode)
    dated = detect(raw, "created", "subreddit")
    docs, stats = canonical.build(dated, cfg, order=("_kind", "_file_idx", "_row_idx"))
    checked, more = canonical.sanity(docs, min(cfg.submission_min_tokens, cfg.comment_min_tokens), order=("created_dt", "text_clean"))
    return checked, stats.unionByName(more.withColumn("stat", F.concat(F.lit("sanity_"), "stat")))


def model(docs: DataFrame, embeddings: DataFrame | None = None, cfg: TopicConfig = TopicConfig(), embedder: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with topics, topic table, yearly statistics); stored embeddings are checked against the documents.

    ``embedder`` (of rows and a text column, see ``topics.embedder``) is what the stored embeddings were made with. Without
    it, documents and terms are embedded by the default for the KeyBERT column, since stored vectors may be of another space."""
    own = embedder or topics.embedder(docs, "text_clean")
    if embeddings is None:
        d = own(docs, "text_clean")
    else:
        forum.check_alignment(docs, embeddings)
        d = docs.join(embeddings.select("doc_id", "embedding"), "doc_id")
    d = topics.cluster(d, "embedding", cfg)
    vectors = d if embeddings is None or embedder else own(d.drop("embedding"), "text_clean")
    d = d.drop("embedding")
    terms = topics.ngrams(topics.words(F.col("text_clean")), cfg.ngrams, topics.stopwords())
    counts = topics.vectorized(topics.term_counts(d, "topic", terms), cfg)
    weights = topics.ctfidf(counts)
    info = topics.topic_info(d, weights, "topic", "text_clean", cfg.top_n_words).join(topics.mmr(weights, cfg.top_n_words, cfg.mmr_diversity).withColumnRenamed("topic", "Topic"), "Topic", "left")
    similar = topics.term_similarity(vectors, "topic", weights, own, cfg.top_n_words)
    info = topics.fallback_label(info.join(topics.keybert(weights, similar, cfg.top_n_words).withColumnRenamed("topic", "Topic"), "Topic", "left"))
    return d, info, explore.yearly_stats(d)


def extract(spark: SparkSession, folder: str, out: str, kind: str = "parquet", save_embeddings: str | None = None, cfg: TopicConfig = TopicConfig(), **options) -> dict[str, DataFrame]:
    docs, stats = documents(spark, folder, **options)
    docs = docs.persist()
    vectors = None
    if save_embeddings:
        forum.save_embeddings(topics.embed(docs, "text_clean"), save_embeddings)
        vectors = forum.load_embeddings(spark, save_embeddings)
    d, info, yearly = model(docs, vectors, cfg)
    tables = {"documents_topics": d, "topic_info": info, "yearly_stats": yearly, "filter_stats": stats}
    forum.write_workbook(tables, out, kind)
    return tables


def reload(spark: SparkSession, documents_path: str, embeddings_path: str, out: str, cfg: TopicConfig = TopicConfig(), kind: str = "parquet") -> dict[str, DataFrame]:
    d, info, yearly = model(spark.read.parquet(documents_path).drop("topic", "topic_probability_max"), forum.load_embeddings(spark, embeddings_path), cfg)
    tables = {"documents_topics": d, "topic_info": info, "yearly_stats": yearly}
    forum.write_workbook(tables, out, kind)
    return tables


def label(info: DataFrame, labeler: Callable[[str], str] = labeling.stub, limiter=None, cfg: RefineConfig = RefineConfig(), calls: LabelerConfig = LabelerConfig()) -> tuple[DataFrame, DataFrame]:
    """(refined topic table, labelled topics)."""
    refined = refine.refine(refine.clean_representatives(info), cfg)
    if "Representative_Docs" in refined.columns:
        d = refined.select("Topic", F.posexplode("Representative_Docs").alias("pos", "doc"))
        d = topics.embed(d.withColumn("doc", F.substring("doc", 1, calls.max_chars)), "doc", 64)
        reps = topics.centroid_farthest(d, "Topic", "embedding", "doc", "pos")
        joined = refined.join(reps, "Topic", "left")
    else:
        joined = refined.withColumns({"rep_doc_centroid": F.lit(""), "rep_doc_farthest": F.lit("")})
    ready = joined.select(
        F.col("Topic").alias("topic_id"), F.col("Count").cast("double").alias("doc_count"), "topic_label_bert", "topic_label_refined",
        F.coalesce("rep_doc_centroid", F.lit("")).alias("rep_doc_centroid"), F.coalesce("rep_doc_farthest", F.lit("")).alias("rep_doc_farthest"),
    )
    return refined, labeling.label_topics(ready, labeler, limiter, calls)


def explore_all(docs: DataFrame, info: DataFrame, out: str | None = None, cfg: RefineConfig = RefineConfig(), kind: str = "csv") -> dict[str, DataFrame]:
    named = explore.working_label(info)
    d = explore.attach(explore.prepare(docs, cfg), named).persist()
    text = named.withColumn("_t", topics.topic_text(named))
    text = text.filter("Topic <> -1") if cfg.exclude_outliers else text
    merges = topics.merge_pairs(topics.tfidf(topics.term_counts(text, "Topic", topics.ngrams(topics.words(F.col("_t")), 2, topics.stopwords((), keep_negations=False)))), cfg)
    tables = explore.all_tables(d, cfg, merges)
    if out:
        forum.write_workbook(tables, out, kind)
    return tables


def funnel_all(labelled: DataFrame, out: str | None = None, weight: str | None = None, exclude_outliers: bool = True, n_topics: int = 3, kind: str = "csv") -> dict[str, DataFrame]:
    tables = funnel.analyze(labelled, weight, exclude_outliers, n_topics)
    if out:
        forum.write_workbook(tables | {f"figure_{k}": v for k, v in figures.pack(tables["stage_summary"], tables["pain_point_summary"], tables["pain_point_table"], tables["topic_deep_dive"]).items()}, out, kind)
    return tables
