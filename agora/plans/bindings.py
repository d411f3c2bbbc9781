"""The test tables seen as forum tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (" see https://ex.org/a?b=1", " thanks u/some_user", " on r/cars", " [label](http://x.y) tail", " **bold** text")

#: Phrases of stages, pain points and none.
BANK = (
    "which car is best for a beginner", "compare hybrid versus electric suv", "total cost with tax credit and loan", "dealer markup over msrp at the dealership", "service and repair problem after buying",
    "long wait list and allocation delay", "monthly payment and apr worry", "range and charging at my apartment garage", "battery replacement warranty issue", "cargo space and comfort features",
    "should i buy now or is it worth waiting?", "deposit paid, delivery unavailable", "insurance and depreciation are uncertain", "salesperson lied under pressure", "recommend a guide for research",
    "weather in the mountains", "music for the evening",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, suffix: bool = True) -> DataFrame:
    """Documents as raw canonical posts."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    tail = F.lit("")
    for k, s in enumerate(SUFFIXES):
        tail = F.when(i % 11 == k, s).otherwise(tail)
    day = F.expr("timestamp_ntz'2013-01-01 00:00:00' + make_dt_interval(CAST(doc_id * 37 % 4380 AS INT))")
    return d.select(
        "doc_id", (i % 3 == 0).alias("is_submission"), F.col("source").alias("subreddit"), F.col("lang").alias("source_tag"),
        F.when(i % 23 == 0, "AutoModerator").when(i % 19 == 0, "helper_bot").when(i % 17 == 0, "[deleted]").otherwise(F.concat(F.lit("user_"), (i % 97).cast("string"))).alias("author"),
        ((i * 7919) % 41 - 3).cast("double").alias("score"), F.when(i % 53 != 0, day).alias("created_dt"), (F.concat("text", tail) if suffix else F.col("text")).alias("text_raw"),
    )


POSTS_SQL = """posts AS (SELECT doc_id, doc_id % 3 = 0 AS is_submission, source AS subreddit, lang AS source_tag,
  CASE WHEN doc_id % 23 = 0 THEN 'AutoModerator' WHEN doc_id % 19 = 0 THEN 'helper_bot' WHEN doc_id % 17 = 0 THEN '[deleted]' ELSE 'user_' || (doc_id % 97) END AS author,
  CAST((doc_id * 7919) % 41 - 3 AS DOUBLE) AS score,
  CASE WHEN doc_id % 53 <> 0 THEN TIMESTAMP '2013-01-01' + to_days(CAST(doc_id * 37 % 4380 AS INTEGER)) END AS created_dt,
  text || CASE doc_id % 11 """ + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SUFFIXES)) + """ ELSE '' END AS text_raw, text FROM documents)"""

#: The markup part of cleaning; the test texts need no other.
CLEAN_SQL = (
    r"""trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text_raw, '\[([^\]]+)\]\(([^)]+)\)', '\1', 'g'), """
    r"""'(?i)https?://\S+|www\.\S+', ' ', 'g'), '\bu/[A-Za-z0-9_-]+\b', ' ', 'g'), '\br/[A-Za-z0-9_-]+\b', ' ', 'g'), '&(?:amp|lt|gt);', ' ', 'g'), '*_`', '   '), '\s+', ' ', 'g'))"""
)
COUNT_SQL = r"CASE WHEN text_clean = '' THEN 0 ELSE len(string_split(text_clean, ' ')) END"
CANON_SQL = POSTS_SQL + f""",
cleaned AS (SELECT *, {CLEAN_SQL} AS text_clean FROM posts),
canon AS (SELECT *, CAST({COUNT_SQL} AS INTEGER) AS n_tokens, CAST(year(created_dt) AS INTEGER) AS created_year, strftime(created_dt, '%Y-%m') AS created_month,
  lower(trim(author)) IN ('[deleted]', 'deleted', 'nan', 'none', '') AS author_deleted FROM cleaned)"""


def doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a topic, a label and a probability."""
    i = F.col("doc_id")
    d = posts(spark, sf_dir, suffix=False).withColumn("topic", (i % 12 - 1).cast("int"))
    return d.select(
        "doc_id", "is_submission", "subreddit", "source_tag", "score", "created_dt", F.year("created_dt").alias("created_year"), "topic", F.concat(F.lit("topic_"), F.col("topic").cast("string")).alias("topic_label_llm"),
        F.when(i % 10 != 0, ((i * 31) % 1000) / 1000.0).alias("topic_probability_max"), F.size(F.split(F.trim("text_raw"), " ")).alias("n_tokens"),
    )


DOC_TOPICS_SQL = POSTS_SQL + """,
doc_topics AS (SELECT doc_id, is_submission, subreddit, source_tag, score, created_dt, CAST(year(created_dt) AS INTEGER) AS created_year, CAST(doc_id % 12 - 1 AS INTEGER) AS topic,
  'topic_' || (doc_id % 12 - 1) AS topic_label_llm, CASE WHEN doc_id % 10 <> 0 THEN ((doc_id * 31) % 1000) / 1000.0::DOUBLE END AS topic_probability_max,
  len(string_split(trim(text), ' ')) AS n_tokens FROM posts)"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funnel input: a row for each document, with texts from a bank of phrases."""
    bank, i = F.array(*map(F.lit, BANK)), F.col("doc_id")
    pick = lambda a, b: F.element_at(bank, ((i * a + b) % len(BANK) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        (i - 1).alias("topic_id"), F.col("n_chars").cast("double").alias("topic_w"), pick(1, 0).alias("topic_label_llm"), pick(7, 3).alias("topic_summary_llm"), pick(5, 1).alias("rep_doc_centroid")
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TOPICS_SQL = f"""bank AS (SELECT {_sql_list(BANK)} AS b),
topics AS (SELECT doc_id - 1 AS topic_id, CAST(n_chars AS DOUBLE) AS topic_weight, b[doc_id % 17 + 1] AS topic_label_llm, b[(doc_id * 7 + 3) % 17 + 1] AS topic_summary_llm,
  b[(doc_id * 5 + 1) % 17 + 1] AS rep_doc_centroid FROM documents, bank),
texts AS (SELECT *, lower(topic_label_llm || ' | ' || topic_summary_llm || ' | ' || rep_doc_centroid) AS combined_text FROM topics WHERE topic_id <> -1)"""


COUNTS_SQL = """tok AS (SELECT source AS topic, unnest(regexp_extract_all(lower(text), '[a-z][a-z]+')) AS term FROM documents),
counts AS (SELECT topic, term, count(*) AS tf FROM tok GROUP BY ALL)"""
