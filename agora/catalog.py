"""Queries by name and their DuckDB equivalents.

Every query reads whole tables. Numbers are rounded to six decimals, since sums of
doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.config import CorpusConfig, RefineConfig, TopicConfig
from agora.functions import text as T
from agora.functions.dates import detect
from agora.operators import canonical as C
from agora.operators import counting as K
from agora.operators import explore as E
from agora.operators import figures as G
from agora.operators import funnel as N
from agora.operators import funnel_rules as R
from agora.operators import labeling as L
from agora.operators import refine as P
from agora.operators import topics as M
from agora.plans import bindings as B
from agora.sources import forum as S
from agora.written import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CFG = CorpusConfig(repair_mojibake=False)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.derive(B.posts(spark, sf_dir), CFG)


# canonical documents


@query(f"WITH {B.CANON_SQL} SELECT doc_id, is_submission, subreddit, source_tag, author, author_deleted, score, strftime(created_dt, '%Y-%m-%d %H:%M:%S') AS created, created_year, created_month, text_raw FROM canon")
def posts_canonical(spark, sf_dir):
    return canon(spark, sf_dir).select(
        "doc_id", "is_submission", "subreddit", "source_tag", "author", "author_deleted", "score", F.date_format("created_dt", "yyyy-MM-dd HH:mm:ss").alias("created"), "created_year", "created_month", "text_raw"
    )


@query(f"WITH {B.CANON_SQL} SELECT doc_id, text_clean FROM canon")
def text_clean_regex(spark, sf_dir):
    return B.posts(spark, sf_dir).select("doc_id", T.strip_markup(F.col("text_raw")).alias("text_clean"))


@query()
def text_clean_full(spark, sf_dir):
    i = F.col("doc_id")
    odd = F.when(i % 5 == 0, " ```code\nhere``` &amp;amp; I`m").when(i % 5 == 1, "\n> quoted line\nand “more” …").when(i % 5 == 2, "​ cafÃ© &eacute;").otherwise("")
    return B.posts(spark, sf_dir).select("doc_id", T.clean(F.concat("text_raw", odd)).alias("text_clean"))


@query(r"SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS INTEGER) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END AS created FROM events)
SELECT event_id, strftime(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN make_timestamp(created * 1000) ELSE make_timestamp(created * 1000000) END, '%Y-%m-%d %H:%M:%S') AS created_dt FROM e""")
def epoch_detect(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    first = e.agg(F.min("event_type")).scalar()
    d = e.select("event_id", "event_type", F.when(F.col("event_type") == first, ms).otherwise(F.floor(ms / 1000)).cast("string").alias("created"))
    return detect(d, "created", "event_type").select("event_id", F.date_format("created_dt", "yyyy-MM-dd HH:mm:ss").alias("created_dt"))


@query(f"WITH {B.CANON_SQL} SELECT doc_id, sha1(source_tag || '|' || subreddit || '|' || CAST(is_submission AS INTEGER) || '|' || coalesce(strftime(created_dt, '%Y-%m-%d %H:%M:%S'), 'NaT') || '|' || author || '|' || text_clean) AS doc_hash FROM canon")
def doc_ids(spark, sf_dir):
    return canon(spark, sf_dir).select("doc_id", C.document_id().alias("doc_hash"))


_FIRST = f"{B.CANON_SQL}, q AS (SELECT subreddit, greatest(quantile_cont(score, 0.25), 1.0) AS threshold FROM canon WHERE NOT is_submission AND n_tokens >= 12 GROUP BY 1)"
_KEEP = {
    "filter_min_tokens": "n_tokens >= CASE WHEN is_submission THEN 6 ELSE 12 END",
    "filter_submission_score": "(NOT is_submission OR coalesce(score, -999999) >= 2)",
    "filter_comment_percentile": "(is_submission OR threshold IS NULL OR score >= threshold)",
    "filter_year_range": "(created_year BETWEEN 2014 AND 2023) IS TRUE",
    "filter_bots": r"NOT (lower(author) = 'automoderator' OR regexp_matches(lower(author), '(?:^|\b)(?:auto\w*|\w*bot\w*)(?:$|\b)') OR contains(lower(text_raw), 'i am a bot') OR contains(lower(text_raw), 'this action was performed automatically') OR contains(lower(text_raw), 'please contact the moderators') OR contains(lower(text_raw), 'bot here'))",
    "filter_generic": "(is_submission OR n_tokens > 20 OR NOT (" + " OR ".join(f"contains(lower(text_clean), '{p}')" for p in ("thanks for sharing", "good luck", "sorry to hear that", "congrats", "congratulations", "check the wiki", "search the sub", "use the search bar")) + r") AND NOT (n_tokens <= 16 AND lower(text_clean) IN ('lol', 'lmao', 'lmfao', 'same', 'this', 'agreed', 'true', 'yep', 'yeah', 'thanks', 'thank you', 'good point', 'exactly', 'for sure', 'interesting', 'nice', 'wow', 'damn', 'idk', 'i dont know', 'who knows', 'maybe', 'depends', 'fair', 'makes sense', 'not sure')) AND NOT (n_tokens <= 5 AND trim(regexp_replace(lower(text_clean), '[^\w\s]', '', 'g')) IN ('', 'lol', 'ok', 'okay', 'yep', 'yeah', 'nah', 'nope')))",
}
_WITH_Q = f"WITH {_FIRST} SELECT canon.doc_id FROM canon LEFT JOIN q USING (subreddit) WHERE "


def _filter(name: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf_dir):
        return keep(canon(spark, sf_dir)).select("doc_id")

    run.__name__ = name
    query(_WITH_Q + _KEEP[name])(run)


_filter("filter_min_tokens", lambda d: d.filter(C.enough_tokens(CFG)))
_filter("filter_submission_score", lambda d: d.filter(C.submission_score(CFG)))
_filter("filter_comment_percentile", lambda d: C.with_comment_threshold(d, CFG, C.enough_tokens(CFG)).filter(C.comment_score()))
_filter("filter_year_range", lambda d: d.filter(C.year_range(CFG)))
_filter("filter_bots", lambda d: d.filter(~C.is_bot(CFG)))
_filter("filter_generic", lambda d: d.filter(~C.is_generic(CFG)))

_CASCADE = f"{_FIRST}, passed AS (SELECT canon.* FROM canon LEFT JOIN q USING (subreddit) WHERE {' AND '.join(_KEEP.values())}), kept AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY is_submission, text_clean ORDER BY doc_id) = 1)"
_REMOVED = "CASE " + " ".join(f"WHEN NOT ({cond}) THEN '{name}'" for name, cond in zip(C.REASONS, _KEEP.values(), strict=True)) + " END"


def cascade(spark, sf_dir):
    return C.cascade(B.posts(spark, sf_dir), CFG, ["doc_id"])


@query(f"WITH {_CASCADE} SELECT doc_id, n_tokens FROM kept")
def filter_cascade(spark, sf_dir):
    return cascade(spark, sf_dir)[1].select("doc_id", "n_tokens")


@query(f"""WITH {_CASCADE}, tagged AS (SELECT {_REMOVED} AS removed_by FROM canon LEFT JOIN q USING (subreddit))
SELECT 'rows_in' AS stat, count(*) AS value FROM tagged UNION ALL SELECT 'rows_out', count(*) FROM kept UNION ALL SELECT 'removed_duplicates', (SELECT count(*) FROM passed) - (SELECT count(*) FROM kept)
""" + " ".join(f"UNION ALL SELECT 'removed_{n}', count(*) FILTER (removed_by = '{n}') FROM tagged" for n in C.REASONS))  # fmt: skip
def filter_stats(spark, sf_dir):
    return C.stats(*cascade(spark, sf_dir))


@query(f"WITH {B.POSTS_SQL} SELECT doc_id FROM posts QUALIFY row_number() OVER (PARTITION BY is_submission, text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf_dir):
    return C.keep_one(B.posts(spark, sf_dir, suffix=False), ["is_submission", "text_raw"], ["doc_id"]).select("doc_id")


@query(f"WITH {B.POSTS_SQL} SELECT doc_id FROM posts QUALIFY row_number() OVER (PARTITION BY is_submission, text ORDER BY doc_id DESC) = 1")
def dedup_keep_last(spark, sf_dir):
    return C.keep_one(B.posts(spark, sf_dir, suffix=False), ["is_submission", "text_raw"], ["doc_id"], "last").select("doc_id")


@query(f"WITH {B.POSTS_SQL} SELECT doc_id FROM posts QUALIFY count(*) OVER (PARTITION BY is_submission, text) = 1")
def dedup_drop_all(spark, sf_dir):
    return C.keep_none(B.posts(spark, sf_dir, suffix=False), ["is_submission", "text_raw"]).select("doc_id")


_SANE = f"{B.CANON_SQL}, h AS (SELECT md5(text) AS doc_hash, doc_id, text_clean, CAST({B.COUNT_SQL} AS INTEGER) AS n FROM canon)"


def _sane(spark, sf_dir):
    d = canon(spark, sf_dir).join(B.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("doc_hash")), "doc_id")
    return C.sanity(d.withColumnRenamed("doc_id", "n0").withColumnRenamed("doc_hash", "doc_id"), 6, ["n0"])


@query(f"WITH {_SANE} SELECT doc_id FROM h WHERE n >= 6 QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY doc_id) = 1")
def sanity_checks(spark, sf_dir):
    return _sane(spark, sf_dir)[0].select(F.col("n0").alias("doc_id"))


@query(f"""WITH {_SANE}, m AS (SELECT *, lower(text_clean) IN ('', '[deleted]', '[removed]', 'deleted', 'removed', 'nan', 'none') AS marker FROM h)
SELECT 'rows_in' AS stat, count(*) AS value FROM m UNION ALL SELECT 'removed_empty_or_marker', count(*) FILTER (marker) FROM m UNION ALL SELECT 'removed_too_short', count(*) FILTER (NOT marker AND n < 6) FROM m
UNION ALL SELECT 'rows_out', count(DISTINCT doc_hash) FROM m WHERE n >= 6 UNION ALL SELECT 'removed_duplicate_id', count(*) - count(DISTINCT doc_hash) FROM m WHERE n >= 6""")
def sanity_stats(spark, sf_dir):
    return _sane(spark, sf_dir)[1]


@query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id AND d.lang = 'en')")
def paired_sources(spark, sf_dir):
    c = B.read(spark, sf_dir, "conversations").withColumn("g", F.col("conv_id").cast("string"))
    s = B.read(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("g"))
    return S.paired_comments(c, s, "g").select("conv_id", "turn")


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'main' WHEN 'src1' THEN 'second' ELSE source END AS source_tag FROM documents")
def source_tags(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", S.source_tag(F.col("source"), S.parse_tags(["src0=main", "SRC1=second"])).alias("source_tag"))


# exploration


@query(f"WITH {B.DOC_TOPICS_SQL}, info AS (SELECT DISTINCT topic AS t, 'label ' || topic AS label FROM doc_topics WHERE topic % 2 = 0) SELECT doc_id, topic, label AS topic_label_refined FROM doc_topics LEFT JOIN info ON t = topic")
def topic_attach_left(spark, sf_dir):
    d = B.doc_topics(spark, sf_dir)
    info = d.filter("topic % 2 = 0").select(F.col("topic").alias("Topic"), F.concat(F.lit("label "), F.col("topic").cast("string")).alias("topic_label_refined")).distinct()
    return E.attach(d, info).select("doc_id", "topic", "topic_label_refined")


_YEARLY = "count(doc_id) AS doc_count, count(DISTINCT CASE WHEN topic >= 0 THEN topic END) AS unique_topics, count(*) FILTER (is_submission) AS submissions, count(*) FILTER (NOT is_submission) AS comments FROM doc_topics"


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT created_year, {_YEARLY} GROUP BY ALL")
def yearly_stats(spark, sf_dir):
    return E.yearly_stats(B.doc_topics(spark, sf_dir), by_tag=False)


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT source_tag, created_year, {_YEARLY} GROUP BY ALL")
def yearly_stats_by_tag(spark, sf_dir):
    return E.yearly_stats(B.doc_topics(spark, sf_dir))


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT topic, topic_label_llm, count(*) AS doc_count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM doc_topics WHERE topic <> -1 GROUP BY ALL")
def topic_prevalence(spark, sf_dir):
    return r6(E.prevalence(B.doc_topics(spark, sf_dir)), "share")


_TRENDS = f"{B.DOC_TOPICS_SQL}, t AS (SELECT created_year, topic, topic_label_llm, count(*) AS count FROM doc_topics WHERE topic <> -1 GROUP BY ALL), trends AS (SELECT *, CASE WHEN created_year IS NOT NULL THEN round(count / sum(count) OVER (PARTITION BY created_year), 6) END AS share_within_year FROM t)"


@query(f"WITH {_TRENDS} SELECT * FROM trends")
def topic_trends(spark, sf_dir):
    return r6(E.trends(B.doc_topics(spark, sf_dir)), "share_within_year")


@query(f"WITH {_TRENDS}, top AS (SELECT topic FROM t GROUP BY topic ORDER BY sum(count) DESC, topic LIMIT 10) SELECT * FROM trends WHERE topic IN (SELECT topic FROM top)")
def top_topic_trends(spark, sf_dir):
    return r6(E.top_trends(B.doc_topics(spark, sf_dir), 10), "share_within_year")


_GROUPS = f"{B.DOC_TOPICS_SQL}, g AS (SELECT subreddit, topic, topic_label_llm, count(*) AS count FROM doc_topics WHERE topic <> -1 GROUP BY ALL), diff AS (SELECT *, count / sum(count) OVER (PARTITION BY subreddit) AS share FROM g)"


@query(f"WITH {_GROUPS} SELECT subreddit, topic, topic_label_llm, count, round(share, 6) AS share_within_group FROM diff")
def group_difference(spark, sf_dir):
    return r6(E.group_difference(B.doc_topics(spark, sf_dir)), "share_within_group")


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT topic, topic_label_llm, count(*) AS doc_count, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score, round(quantile_cont(score, 0.75), 6) AS p75_score, round(avg(n_tokens), 6) AS avg_tokens FROM doc_topics WHERE topic <> -1 GROUP BY ALL HAVING count(*) >= 20")
def engagement(spark, sf_dir):
    return r6(E.engagement(E.prepare(B.doc_topics(spark, sf_dir))), "avg_score", "median_score", "p75_score", "avg_tokens")


@query(f"""WITH {B.DOC_TOPICS_SQL}, p AS (SELECT topic_probability_max AS x FROM doc_topics) SELECT metric, round(value, 6) AS value FROM (SELECT 'count' AS metric, count(x)::DOUBLE AS value FROM p UNION ALL SELECT 'mean', avg(x) FROM p
UNION ALL SELECT 'median', median(x) FROM p UNION ALL SELECT 'p25', quantile_cont(x, 0.25) FROM p UNION ALL SELECT 'p75', quantile_cont(x, 0.75) FROM p UNION ALL SELECT 'min', min(x) FROM p UNION ALL SELECT 'max', max(x) FROM p)""")
def confidence_summary(spark, sf_dir):
    return r6(E.confidence_summary(B.doc_topics(spark, sf_dir)), "value")


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT created_year, count(*) AS doc_count, count(*) FILTER (topic = -1) AS outlier_count, round(count(*) FILTER (topic = -1) / count(*), 6) AS outlier_share FROM doc_topics WHERE created_year IS NOT NULL GROUP BY ALL")
def outlier_share(spark, sf_dir):
    return r6(E.outlier_share(B.doc_topics(spark, sf_dir)), "outlier_share")


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT topic, topic_label_llm, count(*) AS doc_count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM doc_topics WHERE topic_probability_max IS NULL OR topic_probability_max >= 0.5 GROUP BY ALL")
def confidence_filter(spark, sf_dir):
    cfg = RefineConfig(confidence_threshold=0.5, exclude_outliers=False)
    return r6(E.prevalence(E.prepare(B.doc_topics(spark, sf_dir), cfg), cfg), "share")


@query(f"WITH {B.DOC_TOPICS_SQL}, g AS (SELECT CASE source_tag WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS subreddit_group, topic, topic_label_llm, count(*) AS count FROM doc_topics WHERE topic <> -1 GROUP BY ALL) SELECT subreddit_group, topic, topic_label_llm, count, round(count / sum(count) OVER (PARTITION BY subreddit_group), 6) AS share_within_group FROM g")
def mapped_group_difference(spark, sf_dir):
    d = B.doc_topics(spark, sf_dir).drop("subreddit").withColumnRenamed("source_tag", "subreddit")
    return r6(E.group_difference(E.prepare(d, groups={"en": "english", "de": "german"}), "subreddit_group"), "share_within_group")


@query(f"WITH {_GROUPS}, top AS (SELECT topic_label_llm AS l FROM g GROUP BY topic, l ORDER BY sum(count) DESC, topic LIMIT 5) SELECT topic_label_llm, " + ", ".join(f"round(coalesce(avg(share) FILTER (subreddit = 'src{k}'), 0), 6) AS src{k}" for k in range(4)) + " FROM diff WHERE topic_label_llm IN (SELECT l FROM top) GROUP BY ALL")
def heatmap_pivot(spark, sf_dir):
    groups = [f"src{k}" for k in range(4)]
    return r6(E.heatmap(B.doc_topics(spark, sf_dir), groups, 5), *groups)


@query(f"WITH {_GROUPS}, top AS (SELECT topic_label_llm AS l FROM g GROUP BY topic, l ORDER BY sum(count) DESC, topic LIMIT 5), d AS (SELECT topic_label_llm, subreddit, share FROM diff WHERE topic_label_llm IN (SELECT l FROM top)), cells AS (SELECT t.l AS topic_label_llm, s.subreddit FROM top t, (SELECT DISTINCT subreddit FROM d WHERE subreddit IS NOT NULL) s) SELECT topic_label_llm, subreddit, round(coalesce(avg(share), 0), 6) AS share_within_group FROM cells LEFT JOIN d USING (topic_label_llm, subreddit) GROUP BY ALL")
def heatmap_all(spark, sf_dir):
    """The heatmap over all groups, a row for each cell; ``heatmap_pivot`` has the columns of four."""
    d = E.heatmap(B.doc_topics(spark, sf_dir), None, 5)
    return r6(d.unpivot(["topic_label_llm"], [f"`{c}`" for c in d.columns if c != "topic_label_llm"], "subreddit", "share_within_group"), "share_within_group")


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT CAST(least(floor(topic_probability_max * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM doc_topics WHERE topic_probability_max IS NOT NULL GROUP BY ALL")
def prob_histogram(spark, sf_dir):
    return E.histogram(B.doc_topics(spark, sf_dir))


@query(f"WITH {_CASCADE}, t AS (SELECT created_year, CAST(doc_id % 12 - 1 AS INTEGER) AS topic, 'topic_' || (doc_id % 12 - 1) AS topic_label_llm, count(*) AS count FROM kept WHERE doc_id % 12 <> 0 GROUP BY ALL) SELECT *, round(count / sum(count) OVER (PARTITION BY created_year), 6) AS share_within_year FROM t")
def flagship_trend_share(spark, sf_dir):
    d = cascade(spark, sf_dir)[1].withColumn("topic", (F.col("doc_id") % 12 - 1).cast("int")).withColumn("topic_label_llm", F.concat(F.lit("topic_"), F.col("topic").cast("string")))
    return r6(E.trends(d), "share_within_year")


# figures


def _series(unit: str, share: bool) -> str:
    v = "round(value / sum(value) OVER (PARTITION BY period), 6)" if share else "round(value, 6)"
    return f"WITH s AS (SELECT date_trunc('{unit}', ts) AS p, event_type, sum(value) AS value FROM events GROUP BY ALL), t AS (SELECT strftime(p, '%Y-%m-%d') AS period, event_type, value FROM s) SELECT period, event_type AS topic_label, {v} AS value, '{'share' if share else 'count'}' AS metric FROM t"


def _time_series(name: str, freq: str, unit: str, share: bool) -> None:
    def run(spark, sf_dir):
        d = G.time_series(B.read(spark, sf_dir, "events"), "ts", "event_type", "value", freq, share)
        return r6(d.withColumn("period", F.date_format("period", "yyyy-MM-dd")), "value")

    run.__name__ = name
    query(_series(unit, share))(run)


_time_series("time_series_day", "D", "day", False)
_time_series("time_series_week", "W", "week", False)
_time_series("time_series_share_week", "W", "week", True)
_time_series("time_series_share_month", "M", "month", True)


@query("WITH s AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, CASE event_type WHEN 'click' THEN 'Awareness' WHEN 'purchase' THEN 'Purchase' ELSE 'Unmapped' END AS funnel_stage, count(*)::DOUBLE AS value FROM events GROUP BY ALL) SELECT period, funnel_stage, value, 'count' AS metric FROM s")
def stage_time_series(spark, sf_dir):
    m = spark.createDataFrame([("click", "Awareness"), ("purchase", "Purchase"), ("click", "Awareness")], "topic_label_llm string, funnel_stage string")
    d = G.stage_time_series(B.read(spark, sf_dir, "events"), "ts", "event_type", m, freq="W")
    return d.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


_PIVOT = "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{e}'), 0), 6) AS \"{e}\"" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY ALL"


@query(_PIVOT)
def trend_pivot(spark, sf_dir):
    d = G.time_series(B.read(spark, sf_dir, "events"), "ts", "event_type", "value", "W").withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    p = G.pivot(d, "period", "topic_label", "value", 8)
    return r6(p, *[c for c in p.columns if c != "period"])


_FLOW = "flow AS (SELECT event_type AS source, CAST(user_id % 7 AS VARCHAR) AS target, sum(value) AS value FROM events GROUP BY ALL)"


def _flow_input(spark, sf_dir):
    return B.read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).cast("string").alias("bucket"), "value")


@query(f"WITH {_FLOW} SELECT source, target, round(value, 6) AS value FROM flow WHERE value >= 100")
def flow_table(spark, sf_dir):
    return r6(G.flows(_flow_input(spark, sf_dir), "event_type", "bucket", "value", 100.0), "value")


@query(f"WITH {_FLOW} SELECT source, target, round(value, 6) AS value FROM flow ORDER BY CASE flow.source WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 9999 END, flow.source, flow.value DESC, flow.target LIMIT 12")
def flow_ordered(spark, sf_dir):
    return r6(G.ordered_flows(_flow_input(spark, sf_dir), "event_type", "bucket", "value", n=12, source_order=("view", "click")), "value")


_NODES = f"{_FLOW}, names AS (SELECT node, min(side) AS side FROM (SELECT DISTINCT source AS node, 0 AS side FROM flow UNION ALL SELECT DISTINCT target, 1 FROM flow) GROUP BY node), nodes AS (SELECT node, CAST(row_number() OVER (ORDER BY side, node) - 1 AS INTEGER) AS idx FROM names)"


@query(f"WITH {_NODES} SELECT node, idx FROM nodes")
def node_table(spark, sf_dir):
    return G.nodes(G.flows(_flow_input(spark, sf_dir), "event_type", "bucket", "value"))


@query(f"WITH {_NODES} SELECT source, target, round(value, 6) AS value, a.idx AS source_idx, b.idx AS target_idx FROM flow JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target")
def link_table(spark, sf_dir):
    return r6(G.links(G.flows(_flow_input(spark, sf_dir), "event_type", "bucket", "value")), "value")


# funnel


def _q(words) -> str:
    return B._sql_list(words)


def _hits(words, text: str = "combined_text") -> str:
    return f"len(list_filter({_q(words)}, lambda k: contains({text}, k)))"


_TOKENS = f"list_filter(regexp_extract_all(combined_text, '[a-zA-Z][a-zA-Z\\-'']+'), lambda t: len(t) > 2 AND NOT list_contains({_q(R.STOP)}, t))"
_STAGE = "[" + ", ".join(
    f"{{'score': ({_hits(s.include)} + 1.2::DOUBLE * {_hits(s.include, 'lower(topic_label_llm)')} + 0.8::DOUBLE * {_hits(s.include, 'lower(topic_summary_llm)')} + 0.5::DOUBLE * {_hits(s.include, 'lower(rep_doc_centroid)')})::DOUBLE, 'ord': {-s.priority}, 'name': '{s.name}'}}" for s in R.STAGES
) + "]"
_SIGNALS = f"""{B.TOPICS_SQL}, toks AS (SELECT *, {_TOKENS} AS t FROM texts), signals AS (SELECT * EXCLUDE (t), CASE WHEN len(t) = 0 THEN 0 ELSE round(len(list_filter(t, lambda x: list_contains({_q(R.NEGATIVE)}, x))) / len(t) * 20, 4) END AS negative_signal_score,
  round(least(1.0, 0.2::DOUBLE * (len(combined_text) - len(replace(combined_text, '?', ''))) + 0.15::DOUBLE * {_hits(R.QUESTION)}), 4) AS question_signal_score FROM toks)"""
_ASSIGNED = f"""{_SIGNALS}, ranked AS (SELECT *, list_reverse_sort({_STAGE}) AS s FROM signals),
assigned AS (SELECT * EXCLUDE (s), CASE WHEN s[1].score > 0 THEN s[1].name ELSE '{R.UNCLEAR}' END AS funnel_stage, CASE WHEN s[1].score > 0 THEN greatest(0, least(0.99, 0.45::DOUBLE + 0.08::DOUBLE * s[1].score + 0.1::DOUBLE * (s[1].score - s[2].score))) ELSE 0.25 END AS stage_confidence, s[1].score AS stage_match_score FROM ranked)"""


def _prepared(spark, sf_dir):
    return N.prepare(B.topics(spark, sf_dir), "topic_w")


def _assigned(spark, sf_dir):
    return N.assign_stages(_prepared(spark, sf_dir))


@query(f"WITH {B.TOPICS_SQL} SELECT topic_id, combined_text FROM texts")
def combined_text(spark, sf_dir):
    return _prepared(spark, sf_dir).filter("NOT is_outlier").select("topic_id", "combined_text")


@query(f"WITH {_SIGNALS} SELECT topic_id, negative_signal_score, question_signal_score FROM signals")
def text_signals(spark, sf_dir):
    return _prepared(spark, sf_dir).filter("NOT is_outlier").select("topic_id", "negative_signal_score", "question_signal_score")


@query(f"WITH {_ASSIGNED} SELECT topic_id, funnel_stage, round(stage_confidence, 6) AS stage_confidence, round(stage_match_score, 6) AS stage_match_score FROM assigned")
def stage_assign(spark, sf_dir):
    return r6(_assigned(spark, sf_dir), "stage_confidence", "stage_match_score").select("topic_id", "funnel_stage", "stage_confidence", "stage_match_score")


@query()
def stage_reasons(spark, sf_dir):
    return _assigned(spark, sf_dir).select("topic_id", "stage_reason", "stage_keyword_hits", "topic_display", "primary_signal")


_ROLE = "CASE funnel_stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ROLES.items()) + " END"


@query(f"""WITH {_ASSIGNED}, g AS (SELECT funnel_stage, count(topic_id) AS n_topics, sum(topic_weight) AS weighted_topics, avg(stage_confidence) AS c, avg(stage_match_score) AS m, avg(negative_signal_score) AS n, avg(question_signal_score) AS q FROM assigned GROUP BY ALL), s AS (SELECT *, weighted_topics / sum(weighted_topics) OVER () AS share FROM g)
SELECT funnel_stage, n_topics, weighted_topics, round(c, 6) AS avg_confidence, round(m, 6) AS avg_match_score, round(n, 6) AS avg_negative_signal, round(q, 6) AS avg_question_signal, round(share, 6) AS weighted_share, {_ROLE} AS stage_role,
CASE WHEN share IS NULL THEN 'Unknown' WHEN share >= 0.3 AND c >= 0.7 THEN 'High signal concentration' WHEN share >= 0.2 THEN 'Meaningful stage presence' WHEN c < 0.55 THEN 'Needs manual review' ELSE 'Secondary stage' END AS stage_health_flag FROM s""")
def stage_summary(spark, sf_dir):
    return r6(N.stage_summary(_assigned(spark, sf_dir)), "avg_confidence", "avg_match_score", "avg_negative_signal", "avg_question_signal", "weighted_share")


@query()
def stage_insights(spark, sf_dir):
    return N.stage_insights(N.assign_texts(B.topics(spark, sf_dir), "topic_w"))


def _case(rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hits(words)} > 0 THEN '{said}'" for words, said in rules) + f" ELSE '{other}' END"


def _pain(p, order: int) -> str:
    stages = f"CASE WHEN funnel_stage IN ({', '.join(repr(s) for s in p.stages)}) THEN 0.75::DOUBLE ELSE 0 END" if p.stages else "0.5::DOUBLE"
    hits = _hits(p.keywords) if p.keywords else "0"
    return f"{{'score': ({hits} + {stages})::DOUBLE, 'severity': {p.severity}, 'ord': {-order}, 'code': '{p.code}', 'name': '{p.name}', 'hits': ({hits})::INTEGER, 'response': '{p.response}'}}"


_PAINS = f"""{_ASSIGNED}, p0 AS (SELECT *, list_reverse_sort(list_filter([{', '.join(_pain(p, k) for k, p in enumerate(R.PAINS))}], lambda x: x.score > 0)) AS found FROM assigned),
p1 AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 0 THEN found ELSE [{_pain(R.GENERAL, 99)}] END AS p FROM p0),
pains AS (SELECT * EXCLUDE (p, x), x.code AS pain_point_code, x.name AS pain_point_name, x.hits AS pain_keyword_hits, x.score AS pain_score, x.severity AS pain_severity, x.response AS suggested_response,
  round(CAST(topic_weight * (1 + x.score) * (1 + negative_signal_score) * (1 + question_signal_score) AS DECIMAL(24,9)), 4)::DOUBLE AS opportunity_score FROM (SELECT *, unnest(p[1:3]) AS x FROM p1))"""


@query(f"WITH {_PAINS} SELECT topic_id, funnel_stage, topic_weight, pain_point_code, pain_point_name, pain_keyword_hits, pain_score, pain_severity, round(CAST(opportunity_score AS DECIMAL(24,6)), 2)::DOUBLE AS opportunity_score, suggested_response FROM pains")
def pain_points(spark, sf_dir):
    d = N.pain_points(_assigned(spark, sf_dir)).withColumn("opportunity_score", F.round("opportunity_score", 2))
    return d.select("topic_id", "funnel_stage", "topic_weight", "pain_point_code", "pain_point_name", "pain_keyword_hits", "pain_score", "pain_severity", "opportunity_score", "suggested_response")


_FLAG = "CASE WHEN o >= 500 THEN 'Critical intervention opportunity' WHEN o >= 150 THEN 'High-priority friction' WHEN o >= 50 THEN 'Meaningful improvement area' ELSE 'Secondary issue' END"
_SUMMARY = f"{_PAINS}, ps AS (SELECT funnel_stage, pain_point_name, count(DISTINCT topic_id) AS n_topic_hits, sum(topic_weight) AS weighted_volume, avg(pain_score) AS avg_pain_score, round(sum(opportunity_score), 4) AS o FROM pains GROUP BY ALL), pr AS (SELECT *, dense_rank() OVER (PARTITION BY funnel_stage ORDER BY o DESC)::DOUBLE AS rank_within_stage, {_FLAG} AS priority_flag FROM ps)"


@query(f"WITH {_SUMMARY} SELECT funnel_stage, pain_point_name, n_topic_hits, weighted_volume, round(avg_pain_score, 6) AS avg_pain_score, round(CAST(o AS DECIMAL(24,4)), 1)::DOUBLE AS opportunity_score, rank_within_stage, priority_flag FROM pr WHERE rank_within_stage <= 5")
def pain_summary(spark, sf_dir):
    d = N.pain_summary(N.pain_points(_assigned(spark, sf_dir))).withColumn("opportunity_score", F.round("opportunity_score", 1))
    return r6(d, "avg_pain_score").drop("avg_negative_signal", "avg_question_signal")


_FOCUS = "CASE funnel_stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.FOCUS.items()) + f" ELSE '{R.FOCUS_OTHER}' END"


@query(f"WITH {_SUMMARY}, top AS (SELECT *, row_number() OVER (PARTITION BY funnel_stage ORDER BY o DESC, pain_point_name) AS r FROM pr WHERE rank_within_stage <= 3 QUALIFY r <= 3) SELECT funnel_stage, string_agg(pain_point_name, ' || ' ORDER BY r) AS top_pain_points, string_agg(priority_flag, ' || ' ORDER BY r) AS top_priority_flags, round(CAST(sum(o) AS DECIMAL(24,3)), 1)::DOUBLE AS stage_opportunity_score, {_FOCUS} || string_agg(pain_point_name, ', ' ORDER BY r) AS recommended_focus FROM top GROUP BY funnel_stage")
def pain_insights(spark, sf_dir):
    return N.pain_insights(N.pain_points(_assigned(spark, sf_dir))).withColumn("stage_opportunity_score", F.round("stage_opportunity_score", 1))


@query(f"""WITH {_PAINS} SELECT topic_id, funnel_stage, {_case(R.NEEDS, R.NEED_OTHER)} AS customer_need, {_case(R.BARRIERS, R.BARRIER_OTHER)} AS purchase_barrier, p[1].name AS primary_pain_point, p[1].score AS primary_pain_score,
array_to_string(list_distinct_order(regexp_extract_all(combined_text, '{R.SNIPPETS}'))[1:5], ', ') AS decision_signals FROM p1""".replace("list_distinct_order(regexp_extract_all(combined_text, '" + R.SNIPPETS + "'))", "list_filter(regexp_extract_all(combined_text, '" + R.SNIPPETS + "'), lambda x, i: list_position(regexp_extract_all(combined_text, '" + R.SNIPPETS + "'), x) = i)"))
def topic_deep_dive(spark, sf_dir):
    return N.deep_dive(_assigned(spark, sf_dir)).select("topic_id", "funnel_stage", "customer_need", "purchase_barrier", "primary_pain_point", "primary_pain_score", "decision_signals")


@query(f"WITH {_PAINS}, kw AS (SELECT topic_id, combined_text, pain_point_code, list_filter(CASE pain_point_code " + " ".join(f"WHEN '{p.code}' THEN {_q(p.keywords)}" for p in R.PAINS) + " ELSE [] END, lambda k: contains(combined_text, k)) AS m FROM pains), located AS (SELECT *, instr(combined_text, m[1]) AS i FROM kw) SELECT topic_id, pain_point_code, CASE WHEN len(m) = 0 THEN substr(combined_text, 1, 220) ELSE trim(substr(combined_text, greatest(0, i - 71) + 1, least(len(combined_text), i - 1 + len(m[1]) + 120) - greatest(0, i - 71))) END AS evidence_snippet FROM located")
def evidence_snippet(spark, sf_dir):
    return N.pain_points(_assigned(spark, sf_dir)).select("topic_id", "pain_point_code", "evidence_snippet")


@query(f"WITH {_ASSIGNED}, tk AS (SELECT funnel_stage, unnest({_TOKENS}) AS term FROM assigned), c AS (SELECT funnel_stage, term, count(*) AS n FROM tk GROUP BY ALL) SELECT funnel_stage, term, n, CAST(row_number() OVER (PARTITION BY funnel_stage ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def common_terms(spark, sf_dir):
    return N.common_terms(_assigned(spark, sf_dir), "combined_text", ["funnel_stage"])


@query(f"WITH {_PAINS} SELECT funnel_stage, round(coalesce(sum(topic_weight) FILTER (pain_point_code = 'price_markup'), 0), 6) AS price_markup, round(coalesce(sum(topic_weight) FILTER (pain_point_code = 'reliability_risk'), 0), 6) AS reliability_risk FROM pains GROUP BY ALL")
def stage_pain_pivot(spark, sf_dir):
    p = N.pain_points(_assigned(spark, sf_dir))
    out = p.groupBy("funnel_stage").pivot("pain_point_code", ["price_markup", "reliability_risk"]).agg(F.sum("topic_weight")).fillna(0.0)
    return r6(out, "price_markup", "reliability_risk")


_CODES = [p.code for p in (*R.PAINS, R.GENERAL)]


@query(f"WITH {_PAINS} SELECT funnel_stage, " + ", ".join(f"round(coalesce(sum(topic_weight) FILTER (pain_point_code = '{c}'), 0), 6) AS {c}" for c in _CODES) + " FROM pains GROUP BY ALL")
def stage_pain_pivot_all(spark, sf_dir):
    """The stage by pain point table over all codes; ``stage_pain_pivot`` has two of them."""
    p = N.pain_points(_assigned(spark, sf_dir))
    return r6(p.groupBy("funnel_stage").pivot("pain_point_code", _CODES).agg(F.sum("topic_weight")).fillna(0.0), *_CODES)


@query()
def figure_pack_flows(spark, sf_dir):
    """The flows of the figure pack, one under another."""
    a = N.analyze(B.topics(spark, sf_dir), "topic_w")
    p = G.pack(a["stage_summary"], a["pain_point_summary"], a["pain_point_table"], a["topic_deep_dive"])
    return p["stage_pain_flow"].withColumn("figure", F.lit("stage_pain_flow")).unionByName(p["topic_stage_flow"].withColumn("figure", F.lit("topic_stage_flow")))


# topics


def _counts(spark, sf_dir):
    return M.term_counts(B.read(spark, sf_dir, "documents"), "source", M.words(F.col("text")))


_CTFIDF = f"{B.COUNTS_SQL}, w AS (SELECT topic, term, tf, tf / sum(tf) OVER (PARTITION BY topic) * ln(1 + (SELECT avg(s) FROM (SELECT sum(tf) AS s FROM counts GROUP BY topic)) / sum(tf) OVER (PARTITION BY term)) AS weight FROM counts), top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS r FROM w)"


@query(f"WITH {_CTFIDF} SELECT topic, term, tf, round(weight, 6) AS weight FROM w")
def ctfidf_words(spark, sf_dir):
    return r6(M.ctfidf(_counts(spark, sf_dir)), "weight")


@query(f"WITH {_CTFIDF}, c AS (SELECT source AS topic, count(*) AS n FROM documents GROUP BY ALL) SELECT top.topic AS \"Topic\", any_value(n) AS \"Count\", top.topic || '_' || string_agg(term, '_' ORDER BY r) FILTER (r <= 4) AS \"Name\", string_agg(term, ',' ORDER BY r) AS words FROM top JOIN c ON c.topic = top.topic WHERE r <= 10 GROUP BY top.topic")
def topic_info(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents")
    info = M.topic_info(d, M.ctfidf(_counts(spark, sf_dir)), "source")
    return info.select("Topic", "Count", "Name", F.array_join("Representation", ",").alias("words"))


@query("""WITH tk AS (SELECT source AS topic, list_filter(regexp_extract_all(lower(text), '[a-z][a-z]+'), lambda x: NOT list_contains(['the', 'and', 'of', 'to', 'in'], x)) AS t FROM documents),
g AS (SELECT topic, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk), c AS (SELECT topic, term, count(*) AS tf FROM g GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY ALL) SELECT topic, term, tf FROM c WHERE term IN (SELECT term FROM d WHERE df >= 5 AND df <= 0.95 * (SELECT count(DISTINCT topic) FROM c))""")
def count_vectorizer(spark, sf_dir):
    return K.vectorized(B.read(spark, sf_dir, "documents"), "source", "text", 2, ["the", "and", "of", "to", "in"], TopicConfig())


@query("""WITH tok AS (SELECT source AS topic, CAST(2013 + doc_id % 4 AS INTEGER) AS bin, unnest(regexp_extract_all(lower(text), '[a-z][a-z]+')) AS term FROM documents), tf AS (SELECT topic, bin, term, count(*) AS tf FROM tok GROUP BY ALL),
w AS (SELECT *, tf / sum(tf) OVER (PARTITION BY topic, bin) * ln(1 + (SELECT avg(s) FROM (SELECT sum(tf) AS s FROM tf GROUP BY topic)) / sum(tf) OVER (PARTITION BY term)) AS weight FROM tf)
SELECT topic, bin, term, tf, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY topic, bin ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM w QUALIFY rank <= 5""")
def topics_over_time(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents").withColumn("bin", (2013 + F.col("doc_id") % 4).cast("int"))
    return r6(M.topics_over_time(d, "source", "bin", M.words(F.col("text"))), "weight")


_BINNED = """tok AS (SELECT source AS topic, doc_id * 37 % 4380 AS day, regexp_extract_all(lower(text), '[a-z][a-z]+') AS t FROM documents),
edge AS (SELECT min(day) AS low, max(day) AS high FROM tok),
tf AS (SELECT topic, bin, term, count(*) AS tf FROM (SELECT topic, CAST(least(7, floor((day - low) * 8.0 / (high - low))) AS INTEGER) AS bin, unnest(t) AS term FROM tok, edge) GROUP BY ALL)"""


@query(f"""WITH {_BINNED}, t AS (SELECT topic, term, sum(tf) AS n FROM tf GROUP BY ALL), g AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS share, sum(n) OVER (PARTITION BY term) AS f FROM t),
w AS (SELECT topic, bin, term, tf, (tf / sum(tf) OVER (PARTITION BY topic, bin) + share) / 2 * ln(1 + (SELECT avg(s) FROM (SELECT sum(tf) AS s FROM tf GROUP BY topic)) / f) AS weight FROM tf JOIN g USING (topic, term))
SELECT topic, bin, term, tf, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY topic, bin ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM w QUALIFY rank <= 5""")
def topics_over_time_bins(spark, sf_dir):
    d = M.time_bins(B.read(spark, sf_dir, "documents").withColumn("day", F.col("doc_id") * 37 % 4380), "day", 8)
    return r6(M.topics_over_time(d, "source", "bin", M.words(F.col("text")), global_tuning=True), "weight")


@query(f"WITH {B.DOC_TOPICS_SQL} SELECT count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT source_tag)), ',') AS source_tags, count(DISTINCT topic) FILTER (topic <> -1) AS n_topics FROM doc_topics")
def summary_counts(spark, sf_dir):
    return E.summary_counts(B.doc_topics(spark, sf_dir)).withColumn("source_tags", F.array_join("source_tags", ","))


@query(f"WITH {B.COUNTS_SQL}, d AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL), w AS (SELECT topic, term, tf * (ln((1 + (SELECT count(DISTINCT topic) FROM counts)) / (1 + df)) + 1) AS w FROM counts JOIN d USING (term)), n AS (SELECT topic, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic)) AS w FROM w) SELECT a.topic AS topic_a, b.topic AS topic_b, round(round(sum(a.w * b.w), 4), 3) AS similarity FROM n a JOIN n b ON a.term = b.term AND a.topic < b.topic GROUP BY ALL HAVING sum(a.w * b.w) >= 0.55")
def tfidf_merge(spark, sf_dir):
    pairs = M.merge_pairs(M.tfidf(_counts(spark, sf_dir)), RefineConfig(merge_top_pairs=1_000_000))
    return pairs.withColumn("similarity", F.round("similarity", 3))


@query()
def mmr_terms(spark, sf_dir):
    return M.mmr(M.ctfidf(_counts(spark, sf_dir)))


def _similarity(docs: DataFrame, weights: DataFrame) -> DataFrame:
    embed = M.embedder(docs, "text")
    return M.term_similarity(embed(docs, "text"), "source", weights, embed)


@query()
def keybert_terms(spark, sf_dir):
    w = M.ctfidf(_counts(spark, sf_dir))
    sim = _similarity(B.read(spark, sf_dir, "documents"), w)
    return M.keyterms(w, sim)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY ALL),
d AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], c), 9) AS d FROM embeddings JOIN c USING (label))
SELECT label, arg_min(vec_id, (d, vec_id)) AS rep_doc_centroid, arg_min(vec_id, (-d, vec_id)) AS rep_doc_farthest FROM d GROUP BY ALL""")
def centroid_farthest(spark, sf_dir):
    d = B.read(spark, sf_dir, "embeddings").withColumn("pos", F.col("vec_id"))
    return M.centroid_farthest(d, "label", "embedding", "vec_id", "pos")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing_embeddings, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS missing_documents")
def embedding_alignment(spark, sf_dir):
    return S.alignment(B.read(spark, sf_dir, "documents"), B.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))


@query("SELECT doc_id, substr(sha1('v1'), 1, 8) || '_' || substr(sha1('m'), 1, 10) || '_' || sha1(text) AS cache_key, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents")
def cache_hits_misses(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents")
    cache = d.filter("doc_id % 3 = 0").select(S.embedding_key(F.col("text"), "m").alias("cache_key"), F.array(F.lit(0.0)).alias("embedding")).dropDuplicates(["cache_key"])
    hits, misses = S.split_cache(d, cache, "text", "m")
    return hits.select("doc_id", "cache_key", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "cache_key", F.lit(False).alias("hit")))


@query()
def pca_cluster_topics(spark, sf_dir):
    out = M.cluster(B.read(spark, sf_dir, "embeddings"), "embedding")
    return out.select("vec_id", "topic", "topic_probability_max")


@query()
def hashed_embeddings(spark, sf_dir):
    return M.embed(B.read(spark, sf_dir, "documents"), "text", 64).select("doc_id", "embedding")


@query()
def topic_reduce(spark, sf_dir):
    return M.reduce_topics(M.tfidf(_counts(spark, sf_dir)), 5)


@query()
def topic_reduce_auto(spark, sf_dir):
    return M.reduce_topics(M.tfidf(_counts(spark, sf_dir)), "auto")


@query()
def topic_hierarchy(spark, sf_dir):
    return spark.createDataFrame(M.hierarchy(M.tfidf(_counts(spark, sf_dir))), "parent int, left int, right int, similarity double")


def _info(spark, sf_dir, texts: bool = True, words: bool = True):
    """The topic table, with representative texts and with the MMR and KeyBERT words as asked for."""
    docs = B.read(spark, sf_dir, "documents")
    *counted, sums = K.read_once(docs, "source", "text", M.stopwords(), 256 if words else 0)
    w = written(M.top_words(K.top_weights(docs, "source", "text", M.stopwords(), 30, counted), 30).drop("rank"))
    info = M.topic_info(docs, w, "source", "text" if texts else None).filter(F.col("Representation").isNotNull())
    if words:
        m = M.mmr(w).join(M.keybert(w, M.hashed_similarity(docs, "source", "text", w, sums=sums)), "topic")
        info = info.join(m.withColumnRenamed("topic", "Topic"), "Topic")
    order = F.regexp_extract("Topic", r"(\d+)", 1).cast("int")
    return M.fallback_label(info.withColumn("Name", F.regexp_replace("Name", "^src", "")).withColumn("Topic", order))


@query()
def label_candidates(spark, sf_dir):
    d = _info(spark, sf_dir, texts=False)
    return d.select("Topic", F.array_join(P.candidates(d), " | ").alias("candidates"))


@query()
def refined_labels(spark, sf_dir):
    return P.refine(_info(spark, sf_dir, texts=False)).select("Topic", "Count", "topic_label_bert", "topic_label_refined", "topic_keywords_clean", "topic_keybert_clean")


@query()
def representative_docs_clean(spark, sf_dir):
    return P.clean_representatives(_info(spark, sf_dir, words=False)).select("Topic", "Representative_Docs")


@query()
def llm_labels_stub(spark, sf_dir):
    d = P.refine(_info(spark, sf_dir)).select(
        F.col("Topic").alias("topic_id"), F.col("Count").cast("double").alias("doc_count"), "topic_label_bert", "topic_label_refined",
        F.element_at("Representative_Docs", 1).alias("rep_doc_centroid"), F.element_at("Representative_Docs", -1).alias("rep_doc_farthest"),
    )
    return L.label_topics(d)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS calls_24h FROM events")
def rate_limit_window(spark, sf_dir):
    return L.calls_in_day(B.read(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "calls_24h")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
