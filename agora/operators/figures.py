"""Figure data: time series, pivots, flows, nodes, tables. No figures are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.dates import period

UNKNOWN_RANK = 9999


def need(df: DataFrame, columns, name: str = "df") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")


def first_of(df: DataFrame, *names: str) -> str:
    """The first of alternative column names that the frame has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)}")


def time_series(df: DataFrame, date: str, label: str, weight: str | None = None, freq: str = "M", share: bool = False) -> DataFrame:
    """(period, topic_label, value, metric): summed weights or counts per period, or their share of the period."""
    need(df, [date, label])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.select(F.col(date).try_cast("timestamp_ntz").alias("_d"), F.col(label).alias("topic_label"), w.alias("_w")).dropna(subset=["_d", "topic_label"])
    g = d.groupBy(period(F.col("_d"), freq).alias("period"), "topic_label").agg(F.sum("_w").alias("value"))
    if share:
        total = F.sum("value").over(Window.partitionBy("period"))
        g = g.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(0.0))
    return g.withColumn("metric", F.lit("share" if share else "count"))


def stage_time_series(df: DataFrame, date: str, label: str, stages: DataFrame, stage: str = "funnel_stage", map_label: str = "topic_label_llm", **options) -> DataFrame:
    need(stages, [map_label, stage], "stages")
    m = stages.select(F.col(map_label).alias("_l"), F.col(stage).alias("_s")).distinct()
    d = df.join(m, F.col(label).eqNullSafe(F.col("_l")), "left").withColumn("_s", F.coalesce("_s", F.lit("Unmapped")))
    return time_series(d, date, "_s", **options).withColumnRenamed("topic_label", "funnel_stage")


def top_labels(df: DataFrame, n: int, label: str = "topic_label", value: str = "value") -> DataFrame:
    return df.groupBy(label).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), label).limit(n).select(label)


def pivot(df: DataFrame, row: str, column: str, value: str, n: int, agg=F.sum) -> DataFrame:
    """Rows by the n columns of greatest total, greatest first; 0 where nothing is. The names collected are n at most."""
    names = [r[0] for r in df.groupBy(column).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), column).limit(n).collect()]
    return df.filter(F.col(column).isin(*names)).groupBy(row).pivot(column, names).agg(agg(value)).fillna(0)


def rank_in(c: Column, order) -> Column:
    lookup = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(lookup, c), F.lit(UNKNOWN_RANK))


def flows(df: DataFrame, source: str, target: str, value: str = "topic_weight", least: float = 0.0) -> DataFrame:
    need(df, [source, target, value])
    g = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.sum(value).alias("value"))
    return g.filter(F.col("value") >= least)


def ordered_flows(df: DataFrame, source: str, target: str, value: str = "topic_weight", least: float = 0.0, n: int | None = None, source_order=None, target_order=None) -> DataFrame:
    f = flows(df, source, target, value, least)
    keys = [rank_in(F.col("source"), source_order).asc()] if source_order else []
    keys += [F.col("source").asc(), F.col("value").desc()]
    keys += [rank_in(F.col("target"), target_order).asc()] if target_order else []
    keys.append(F.col("target").asc())
    f = f.orderBy(*keys)
    return f if n is None else f.limit(n)


def nodes(links: DataFrame) -> DataFrame:
    """(node, idx): sources by name, then what only occurs as a target. Node tables are small: one row for each label."""
    s = links.select(F.col("source").alias("node")).distinct().withColumn("_side", F.lit(0))
    t = links.select(F.col("target").alias("node")).distinct().withColumn("_side", F.lit(1))
    g = s.unionByName(t).groupBy("node").agg(F.min("_side").alias("_side"))
    return g.select("node", (F.row_number().over(Window.orderBy("_side", "node")) - 1).alias("idx"))


def links(flow: DataFrame) -> DataFrame:
    """Flows with the numbers of their nodes."""
    n = nodes(flow)
    a, b = n.select(F.col("node").alias("source"), F.col("idx").alias("source_idx")), n.select(F.col("node").alias("target"), F.col("idx").alias("target_idx"))
    return flow.join(a, "source").join(b, "target").select("source", "target", "value", "source_idx", "target_idx")


def table(df: DataFrame, columns=None, rows: int = 12, rounded=(), order=(), percents=()) -> DataFrame:
    """A table as shown: chosen columns, the first rows by ``order`` (else by the columns shown), numbers with three
    decimals, shares as per cent."""
    d = df.select(*columns) if columns else df
    d = d.withColumns({c: F.format_string("%.1f%%", 100 * F.col(c).cast("double")) for c in percents if c in d.columns})
    return d.orderBy(*(order or d.columns)).limit(rows).withColumns({c: F.format_string("%.3f", F.col(c).cast("double")) for c in rounded if c in d.columns})


STAGE_ORDER = ("Awareness", "Consideration", "Evaluation", "Purchase", "Ownership", "Unclear / Cross-Stage")


def bars(df: DataFrame, label: str, value: str, n: int = 15) -> DataFrame:
    """(label, value, position) of the n greatest values; horizontal bars are drawn upward, so the greatest is last."""
    top = df.select(label, value).orderBy(F.desc(value), label).limit(n)
    return top.withColumn("position", (F.row_number().over(Window.orderBy(F.asc(value), F.desc(label))) - 1).cast("int"))


def pack(stage_summary=None, pain_summary=None, pain_table=None, deep_dive=None, sankey: bool = True) -> dict[str, DataFrame]:
    """Data of the whole figure pack, for the tables that are given."""
    out = {}
    if stage_summary is not None:
        w = first_of(stage_summary, "weighted_topics", "n_topics")
        out["stage_distribution"] = stage_summary.select("funnel_stage", F.col(w).alias("value"))
        out["stage_confidence"] = stage_summary.select("funnel_stage", "avg_confidence")
    if pain_summary is not None:
        n = first_of(pain_summary, "pain_point_name", "pain_point_label")
        v = first_of(pain_summary, "weighted_volume", "weighted_topics")
        out["pain_opportunity"] = pain_summary.orderBy(F.desc("opportunity_score"), n).limit(12).select("funnel_stage", F.col(n).alias("pain_point"), "opportunity_score", F.col(v).alias("volume"))
    if pain_table is not None:
        n = first_of(pain_table, "pain_point_name", "pain_point_label")
        out["stage_pain_heatmap"] = pivot(pain_table, "funnel_stage", n, "topic_weight", 10)
        if sankey:
            out["stage_pain_flow"] = ordered_flows(pain_table, "funnel_stage", n, n=20, source_order=STAGE_ORDER)
    if deep_dive is not None:
        out["topic_table"] = table(deep_dive, rounded=("topic_weight", "stage_confidence"))
        if sankey:
            out["topic_stage_flow"] = ordered_flows(deep_dive, "topic_label_llm", "funnel_stage", n=25, target_order=STAGE_ORDER)
    return out
