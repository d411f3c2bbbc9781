"""Canonical documents: projection, cleaning, the filter cascade, dedup and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora import config
from agora.config import CorpusConfig
from agora.functions import text as T
from agora.written import written

COLUMNS = (
    "doc_id", "is_submission", "subreddit", "source_tag", "created_dt", "created_year", "created_month", "author", "author_deleted", "score",
    "is_bot", "is_generic_comment", "link", "url", "title", "selftext", "text_raw", "text_clean", "n_tokens",
)


def _get(df: DataFrame, name: str | None, kind: str = "string") -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def _numbered(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("_row_idx",) if c in df.columns]


def from_submissions(df: DataFrame, author="author", title="title", body="text", created="created", score="score", link="link", url="url", group="subreddit", tag="source_tag") -> DataFrame:
    """Raw submissions as canonical rows; missing columns are null."""
    head = T.strip(F.coalesce(_get(df, title).cast("string"), F.lit("")))
    text = F.coalesce(_get(df, body).cast("string"), F.lit(""))
    text = F.when(T.is_marker(text), "").otherwise(T.strip(text))
    return df.select(
        F.lit(True).alias("is_submission"), _get(df, group).alias("subreddit"), _get(df, tag).alias("source_tag"), _get(df, created).alias("created"),
        _get(df, author).alias("author"), _get(df, score).try_cast("double").alias("score"), _get(df, link).alias("link"), _get(df, url).alias("url"),
        _get(df, title).alias("title"), _get(df, body).alias("selftext"), T.strip(F.concat(head, F.lit(" "), text)).alias("text_raw"), *_numbered(df),
    )


def from_comments(df: DataFrame, author="author", body="body", created="created", score="score", link="link", group="subreddit", tag="source_tag") -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(False).alias("is_submission"), _get(df, group).alias("subreddit"), _get(df, tag).alias("source_tag"), _get(df, created).alias("created"),
        _get(df, author).alias("author"), _get(df, score).try_cast("double").alias("score"), _get(df, link).alias("link"), none.alias("url"),
        none.alias("title"), none.alias("selftext"), F.coalesce(_get(df, body).cast("string"), F.lit("")).alias("text_raw"), *_numbered(df),
    )


def derive(df: DataFrame, cfg: CorpusConfig = CorpusConfig(), entities: bool = True) -> DataFrame:
    """text_clean, n_tokens, author_deleted, created_year and created_month."""
    author = F.lower(T.strip(F.col("author")))
    return (
        df.withColumn("text_clean", T.clean(F.col("text_raw"), cfg.repair_mojibake, entities))
        .withColumn("n_tokens", T.token_count(F.col("text_clean")))
        .withColumns({
            "author_deleted": F.coalesce(author.isin(*config.DELETED_AUTHORS), F.lit(True)),
            "created_year": F.year("created_dt"),
            "created_month": F.date_format("created_dt", "yyyy-MM"),
        })
    )


# the filters, as conditions to keep a row


def enough_tokens(cfg: CorpusConfig) -> Column:
    return F.col("n_tokens") >= F.when(F.col("is_submission"), cfg.submission_min_tokens).otherwise(cfg.comment_min_tokens)


def submission_score(cfg: CorpusConfig) -> Column:
    if cfg.submission_min_score is None:
        return F.lit(True)
    return ~F.col("is_submission") | (F.coalesce("score", F.lit(-999999.0)) >= cfg.submission_min_score)


def with_comment_threshold(df: DataFrame, cfg: CorpusConfig, alive: Column | None = None) -> DataFrame:
    """``score_threshold``: the quantile of a group's comment scores, between floor and cap. ``alive`` marks the
    rows that earlier filters keep. Groups are joined back from an aggregate, so none is gathered in one task."""
    comments = df.filter(~F.col("is_submission") & (F.lit(True) if alive is None else alive))
    if cfg.comment_score_quantile is None:
        return df.withColumn("score_threshold", F.lit(cfg.min_comment_score).cast("double"))
    q = F.greatest(F.percentile("score", cfg.comment_score_quantile), F.lit(float(cfg.comment_score_floor)))
    q = q if cfg.comment_score_cap is None else F.least(q, F.lit(float(cfg.comment_score_cap)))
    facts = comments.filter("score IS NOT NULL").groupBy(F.col("subreddit").alias("_g")).agg(q.alias("_q"))
    joined = df.join(facts, F.col("subreddit").eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("score_threshold", F.coalesce("_q", F.lit(cfg.min_comment_score).cast("double"))).drop("_g", "_q")


def comment_score() -> Column:
    return F.col("is_submission") | F.col("score_threshold").isNull() | F.coalesce(F.col("score") >= F.col("score_threshold"), F.lit(False))


def year_range(cfg: CorpusConfig) -> Column:
    ok = F.lit(True)
    if cfg.start_year is not None:
        ok = ok & (F.col("created_year") >= cfg.start_year)
    if cfg.end_year is not None:
        ok = ok & (F.col("created_year") <= cfg.end_year)
    return F.coalesce(ok, F.lit(False))


def is_bot(cfg: CorpusConfig = CorpusConfig()) -> Column:
    author = F.coalesce(F.lower(T.strip(F.col("author"))), F.lit(""))
    by_name = (author == "automoderator") | author.rlike("(?U)" + config.BOT_AUTHOR) if cfg.drop_bots else F.lit(False)
    by_text = T.contains_any(F.lower(F.coalesce("text_raw", F.lit(""))), config.BOT_PHRASES) if cfg.drop_bot_phrases else F.lit(False)
    return by_name | by_text


def is_generic(cfg: CorpusConfig = CorpusConfig()) -> Column:
    if not cfg.drop_generic:
        return F.lit(False)
    norm, n = T.normalized(F.col("text_clean")), F.col("n_tokens")
    bare = T.strip(F.regexp_replace(norm, r"(?U)[^\w\s]", ""))
    hit = (n <= cfg.generic_max_tokens) & norm.isin(*config.GENERIC_EXACT)
    hit = hit | (n <= max(cfg.generic_max_tokens, 20)) & T.contains_any(norm, config.GENERIC_CONTAINS)
    return ~F.col("is_submission") & (hit | (n <= 5) & bare.isin(*config.QUICK_REACTIONS))


#: Filters by name, in order; each but that of comment scores is a condition on a row alone.
REASONS = ("too_few_tokens", "low_submission_score", "low_comment_score", "year_out_of_range", "bot", "generic_comment")


def judge(df: DataFrame, cfg: CorpusConfig = CorpusConfig()) -> DataFrame:
    """``failed``: the names of the filters that a row fails by itself; ``text_dedup``: the text in normal form."""
    checks = {"too_few_tokens": enough_tokens(cfg), "low_submission_score": submission_score(cfg), "year_out_of_range": year_range(cfg), "bot": ~is_bot(cfg), "generic_comment": ~is_generic(cfg)}
    failed = F.array_compact(F.array(*[F.when(keep, F.lit(None)).otherwise(F.lit(name)) for name, keep in checks.items()]))
    return df.withColumns({"failed": failed, "text_dedup": T.normalized(F.col("text_clean"))})


def tag_cascade(judged: DataFrame, cfg: CorpusConfig = CorpusConfig()) -> DataFrame:
    """``removed_by``: the first filter that removes a judged row, null if none does. The comment threshold comes
    from rows that the first two filters keep."""
    fails = lambda name: F.array_contains("failed", name)
    d = with_comment_threshold(judged, cfg, ~fails(REASONS[0]) & ~fails(REASONS[1]))
    chain = F.lit(None).cast("string")
    for name in reversed(REASONS):
        chain = F.when(~comment_score() if name == "low_comment_score" else fails(name), name).otherwise(chain)
    return d.withColumn("removed_by", chain).drop("failed", "score_threshold")


def cascade(df: DataFrame, cfg: CorpusConfig, order, entities: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all rows with ``removed_by``, those that stay after dedup) from canonical raw rows with created_dt. Cleaning is the
    costly part, so what it gives is written once; thresholds, tags and dedup read the columns they need from there."""
    tagged = tag_cascade(written(judge(derive(df, cfg, entities), cfg)), cfg)
    return tagged, dedup(tagged.filter("removed_by IS NULL"), cfg, order)


def keep_one(df: DataFrame, keys, order, keep: str = "first") -> DataFrame:
    """One row for each key, the first or last by ``order`` (unlike dropDuplicates, always the same one). Tasks drop
    all but their own first row of a key before the exchange, so a common key isn't gathered."""
    o = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).filter("_r = 1").drop("_r")


def keep_none(df: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs once."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    on = None
    for k in keys:
        c = df[k].eqNullSafe(once[k])
        on = c if on is None else on & c
    return df.join(once, on, "left_semi")


def dedup(df: DataFrame, cfg: CorpusConfig, order) -> DataFrame:
    d = df if "text_dedup" in df.columns else df.withColumn("text_dedup", T.normalized(F.col("text_clean")))
    keys = cfg.dedup_keys or ((cfg.dedup_on,) if cfg.dedup_on else None)
    if keys is None:
        return d
    return keep_none(d, keys) if cfg.dedup_keep == "none" else keep_one(d, keys, order, cfg.dedup_keep)


def document_id() -> Column:
    """SHA-1 over six parts; a missing author or date is written as in the tables it came from."""
    created = F.date_format("created_dt", "yyyy-MM-dd HH:mm:ss")
    n = lambda c, none: F.coalesce(c, F.lit(none))
    return T.sha1_of(
        n(F.col("source_tag"), ""), n(F.col("subreddit"), ""), F.col("is_submission").cast("int").cast("string"), n(created, "NaT"), n(F.col("author"), "nan"), n(F.col("text_clean"), "")
    )


def stats(tagged: DataFrame, final: DataFrame) -> DataFrame:
    """(stat, value): rows in, removed by each filter and by dedup, and kept. One pass over the tagged rows."""
    counts = tagged.agg(F.count("*").alias("rows_in"), *[F.count_if(F.coalesce(F.col("removed_by") == r, F.lit(False))).alias(f"removed_{r}") for r in REASONS], F.count_if(F.col("removed_by").isNull()).alias("removed_duplicates"))
    kept = final.agg(F.count("*").alias("rows_out"), (-F.count("*")).alias("removed_duplicates"))
    return _added(counts, kept)


def _added(*wide: DataFrame) -> DataFrame:
    """(stat, value) over one-row frames; values of one name are added."""
    out = None
    for w in wide:
        rows = w.unpivot([], w.columns, "stat", "value")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("stat").agg(F.sum("value").alias("value"))


def build(df: DataFrame, cfg: CorpusConfig = CorpusConfig(), order=("_file_idx", "_row_idx"), entities: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, statistics) from canonical raw rows with created_dt."""
    tagged, final = cascade(df, cfg, order, entities)
    flags = {"doc_id": document_id(), "is_bot": F.lit(False), "is_generic_comment": F.lit(False)}
    out = final.withColumns({k: v for k, v in flags.items()})
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*COLUMNS), stats(tagged, final)


def sanity(df: DataFrame, min_tokens: int, order=("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Rows that are neither markers nor short, one for each id; and the counts of what went."""
    marker = F.lower(T.strip(F.coalesce("text_clean", F.lit("")))).isin(*config.TEXT_MARKERS)
    short = ~marker & (T.token_count(F.col("text_clean")) < min_tokens)
    good = df.filter(~marker & ~short)
    kept = keep_one(good, ["doc_id"], order)
    counts = df.agg(F.count("*").alias("rows_in"), F.count_if(marker).alias("removed_empty_or_marker"), F.count_if(short).alias("removed_too_short"), F.count_if(~marker & ~short).alias("removed_duplicate_id"))
    return kept, _added(counts, kept.agg(F.count("*").alias("rows_out"), (-F.count("*")).alias("removed_duplicate_id")))
