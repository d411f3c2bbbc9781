"""Command line: python -m agora extract|reload|refine|explore|funnel ..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from agora import session
from agora.config import LabelerConfig, RefineConfig, TopicConfig
from agora.operators import labeling
from agora.operators.labeling import CallLog, RateLimiter
from agora.plans import stages
from agora.sources import forum


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="agora", description=__doc__)
    sub = p.add_subparsers(dest="stage", required=True)
    x = sub.add_parser("extract")
    x.add_argument("--input", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--source-tag", nargs="*", default=[], metavar="NAME=TAG")
    x.add_argument("--subreddits", nargs="*", default=[])
    x.add_argument("--data-type", choices=forum.MODES, default="all")
    x.add_argument("--save-embeddings")
    r = sub.add_parser("reload")
    for name in ("documents", "embeddings", "output"):
        r.add_argument(f"--{name}", required=True)
    for name in ("components", "min-cluster-size", "nr-topics"):
        r.add_argument(f"--{name}", type=int)
    f = sub.add_parser("refine")
    f.add_argument("--topics", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--min-interval", type=float, default=LabelerConfig.min_interval_s)
    f.add_argument("--daily-limit", type=int, default=LabelerConfig.calls_per_day)
    f.add_argument("--call-log")
    f.add_argument("--labeler", default="stub", help="stub, or module:function of a backend")
    e = sub.add_parser("explore")
    for name in ("documents", "topics", "output"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--min-docs", type=int, default=RefineConfig.min_docs)
    e.add_argument("--confidence", type=float)
    e.add_argument("--top-overall", type=int, default=RefineConfig.top_n_overall)
    e.add_argument("--top-trend", type=int, default=RefineConfig.top_n_trend)
    e.add_argument("--include-outliers", action="store_true")
    n = sub.add_parser("funnel")
    n.add_argument("--topics", required=True)
    n.add_argument("--output", required=True)
    n.add_argument("--top-topics", type=int, default=3)
    n.add_argument("--include-outliers", action="store_true")
    n.add_argument("--weight")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session.build()
    if a.stage == "extract":
        forum.must_exist(a.input)
        stages.extract(spark, a.input, a.output, save_embeddings=a.save_embeddings, tags=forum.parse_tags(a.source_tag), targets=forum.parse_targets(a.subreddits), mode=a.data_type)
    elif a.stage == "reload":
        changed = {k: v for k, v in (("components", a.components), ("min_cluster_size", a.min_cluster_size), ("nr_topics", a.nr_topics)) if v is not None}
        stages.reload(spark, a.documents, a.embeddings, a.output, replace(TopicConfig(), **changed))
    elif a.stage == "refine":
        calls = LabelerConfig(min_interval_s=a.min_interval, calls_per_day=a.daily_limit)
        limiter = None if a.labeler == "stub" and not a.call_log else RateLimiter(calls, CallLog(a.call_log) if a.call_log else None)
        refined, labelled = stages.label(spark.read.parquet(a.topics), labeling.find(a.labeler), limiter, calls=calls)
        forum.write_workbook({"topic_labels_refined": refined, "topic_labels_llm": labelled}, a.output, "parquet")
    elif a.stage == "explore":
        cfg = RefineConfig(top_n_overall=a.top_overall, top_n_trend=a.top_trend, min_docs=a.min_docs, confidence_threshold=a.confidence, exclude_outliers=not a.include_outliers)
        stages.explore_all(spark.read.parquet(a.documents), spark.read.parquet(a.topics), a.output, cfg)
    else:
        stages.funnel_all(spark.read.parquet(a.topics), a.output, a.weight, not a.include_outliers, a.top_topics)


if __name__ == "__main__":
    main()
