"""Funnel analysis of topics: stages, pain points, opportunities, insights.

Rules are literal arrays searched by lambdas, so the plan stays small however many
words there are, and everything runs in the JVM. Scores are ranked with the rule's
own order as the last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import funnel_rules as R
from agora.written import written

TEXT_COLUMNS = ("topic_label_llm", "topic_summary_llm", "topic_label_refined", "topic_label_bert", "rep_doc_centroid", "rep_doc_farthest")


def validate(df: DataFrame) -> None:
    missing = {"topic_id"} - set(df.columns)
    if missing or not set(TEXT_COLUMNS) & set(df.columns):
        raise ValueError(f"needs topic_id and one of {', '.join(TEXT_COLUMNS)}; missing: {sorted(missing)}")


def clean(c: Column) -> Column:
    """Lower case, plain apostrophes, single spaces."""
    t = F.lower(c)
    for odd in ("â€™", "’"):
        t = F.replace(t, F.lit(odd), F.lit("'"))
    return T.collapse(t)


def tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z][a-zA-Z\-']+"), F.lit(0))
    stop = F.array(*map(F.lit, R.STOP))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def negative_signal(c: Column) -> Column:
    t = tokens(c)
    words = F.array(*map(F.lit, R.NEGATIVE))
    hits = F.size(F.filter(t, lambda x: F.array_contains(words, x)))
    return F.when(F.size(t) == 0, 0.0).otherwise(F.round(hits / F.size(t) * 20, 4))


def question_signal(c: Column) -> Column:
    t = clean(c)
    marks = F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    return F.round(F.least(F.lit(1.0), marks * 0.2 + F.size(T.matched(t, R.QUESTION)) * 0.15), 4)


def prepare(df: DataFrame, weight: str | None = None, outlier: int = -1) -> DataFrame:
    """Text columns without nulls, topic_weight, is_outlier (by text), combined_text and both signals."""
    validate(df)
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in TEXT_COLUMNS}
    d = df.withColumns(texts).withColumns({
        "topic_weight": F.col(weight).cast("double") if weight else F.lit(1.0),
        "is_outlier": F.coalesce(F.col("topic_id").cast("string") == str(outlier), F.lit(False)),
        "combined_text": clean(F.concat_ws(" | ", *[F.when(T.strip(F.col(c)) != "", F.col(c)) for c in TEXT_COLUMNS])),
    })
    return d.withColumns({"negative_signal_score": negative_signal(F.col("combined_text")), "question_signal_score": question_signal(F.col("combined_text"))})


def _stage_scores(stages) -> Column:
    """All stages with score and hits, best first, ties by priority. Stages are one literal array, so that the
    expression doesn't grow with their number."""
    ordered = sorted(stages, key=lambda s: s.priority)
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")
    rules = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(s.name).alias("name"), words(s.include).alias("include"), words(s.exclude).alias("exclude")) for k, s in enumerate(ordered)])
    found = lambda w, c: F.filter(w, lambda k: F.contains(c, k))
    n = lambda w, c: F.size(found(w, c))

    def scored(s, of):
        score = n(s["include"], of["text"]) - n(s["exclude"], of["text"]) + n(s["include"], of["label"]) * 1.2 + n(s["include"], of["summary"]) * 0.8 + n(s["include"], of["centroid"]) * 0.5
        return F.struct(score.cast("double").alias("score"), s["order"].alias("order"), s["name"].alias("name"), F.array_sort(F.array_distinct(found(s["include"], of["text"]))).alias("hits"))

    # texts are cleaned once, outside the lambdas: inlined there they would be cleaned for each word
    texts = F.struct(F.col("combined_text").alias("text"), *[clean(F.col(c)).alias(a) for c, a in (("topic_label_llm", "label"), ("topic_summary_llm", "summary"), ("rep_doc_centroid", "centroid"))])
    return T.let(texts, lambda of: F.sort_array(F.transform(rules, lambda s: scored(s, of)), asc=False))


def assign_stages(prepared: DataFrame, exclude_outliers: bool = True, stages=R.STAGES) -> DataFrame:
    """Stage, confidence, score, reason and hits of each topic."""
    d = prepared.filter(~F.col("is_outlier")) if exclude_outliers else prepared
    d = d.withColumn("_s", _stage_scores(stages))
    best, second = F.element_at("_s", 1), F.coalesce(F.try_element_at("_s", F.lit(2))["score"], F.lit(0.0))
    clear, margin = best["score"] > 0, best["score"] - second
    ending = F.format_string("; score=%.2f, margin_vs_next=%.2f", best["score"], margin)
    cues = F.concat(F.lit(" due to signals: "), F.array_join(F.slice(best["hits"], 1, 6), ", "))
    reason = F.concat(F.lit("Assigned to "), best["name"], F.when(F.size(best["hits"]) > 0, cues).otherwise(" based on overall topic wording"), ending)
    label = F.when(F.col("topic_label_llm") != "", F.col("topic_label_llm")).otherwise(F.col("topic_label_refined"))
    summary = T.truncate(F.col("topic_summary_llm"), 180, "...")
    out = d.withColumn("_display", F.concat(label, F.lit(" | "), summary)).withColumns({
        "funnel_stage": F.when(clear, best["name"]).otherwise(R.UNCLEAR),
        "stage_confidence": F.when(clear, F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.lit(0.45) + best["score"] * 0.08 + margin * 0.1))).otherwise(0.25),
        "stage_match_score": best["score"],
        "stage_reason": F.when(clear, reason).otherwise(R.UNCLEAR_REASON),
        "stage_keyword_hits": F.when(clear, F.substring(F.array_join(best["hits"], ", "), 1, 500)).otherwise(""),
        "topic_display": F.expr("trim(BOTH ' |' FROM _display)"),
    })
    return out.withColumn("primary_signal", F.element_at(F.split("stage_reason", ";"), 1)).drop("_s", "_display")


def assign_texts(df: DataFrame, weight: str | None = None, exclude_outliers: bool = True, stages=R.STAGES) -> DataFrame:
    """``assign_stages`` of ``prepare``, with the topic's pain points as ``_all``: what follows from texts alone is found
    once for each combination of texts, written, and joined to its topics."""
    validate(df)
    texts = [c for c in TEXT_COLUMNS if c in df.columns]
    d = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts}).withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    scored = assign_stages(prepare(d.select(*texts).distinct().withColumn("topic_id", F.lit("")), None), False, stages).withColumn("_all", pain_scores())
    scored = written(scored.drop("topic_id", "topic_weight", "is_outlier"))
    rest = [c for c in scored.columns if c not in texts]
    scored = scored.select(*[F.col(c).alias(f"_{c}") for c in texts], *rest)
    same = [F.col(c) == F.col(f"_{c}") for c in texts]
    found = d.drop(*rest).join(scored, same).drop(*[f"_{c}" for c in texts])
    out = found.withColumns({"topic_weight": F.col("_w"), "is_outlier": F.coalesce(F.col("topic_id").cast("string") == "-1", F.lit(False))}).drop("_w")
    return out.filter(~F.col("is_outlier")) if exclude_outliers else out


def by_text(text: Column, rules, other: str) -> Column:
    """The text of the first rule of which a word occurs."""
    out = F.lit(other)
    for words, said in reversed(rules):
        out = F.when(T.contains_any(text, words), said).otherwise(out)
    return out


def by_stage(stage: Column, texts: dict[str, str], other: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[stage], F.lit(other) if isinstance(other, str) else other)


def friction(stage: Column, text: Column) -> Column:
    out = F.lit(R.FRICTION_OTHER)
    for name, (words, *said) in R.FRICTION.items():
        value = F.lit(said[0]) if not words else F.when(T.contains_any(F.lower(text), words), said[0]).otherwise(said[1])
        out = F.when(stage == name, value).otherwise(out)
    return out


def stage_summary(assigned: DataFrame) -> DataFrame:
    g = assigned.groupBy("funnel_stage").agg(
        F.count("topic_id").alias("n_topics"), F.sum("topic_weight").alias("weighted_topics"), F.avg("stage_confidence").alias("avg_confidence"), F.avg("stage_match_score").alias("avg_match_score"),
        F.avg("negative_signal_score").alias("avg_negative_signal"), F.avg("question_signal_score").alias("avg_question_signal"),
    )
    total = F.sum("weighted_topics").over(Window.partitionBy())
    g = g.withColumn("weighted_share", F.when(total > 0, F.col("weighted_topics") / total))
    flag = (
        F.when(F.col("weighted_share").isNull(), "Unknown").when((F.col("weighted_share") >= 0.3) & (F.col("avg_confidence") >= 0.7), "High signal concentration")
        .when(F.col("weighted_share") >= 0.2, "Meaningful stage presence").when(F.col("avg_confidence") < 0.55, "Needs manual review").otherwise("Secondary stage")
    )
    return g.withColumns({"stage_role": by_stage(F.col("funnel_stage"), R.ROLES, F.lit(None).cast("string")), "stage_health_flag": flag})


def common_terms(df: DataFrame, text: str, keys: list[str], k: int = 10) -> DataFrame:
    """The k most frequent tokens of each group, ties by the token: (keys, term, n, rank)."""
    g = df.select(*keys, F.explode(tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return g.withColumn("rank", r).filter(F.col("rank") <= k)


def stage_insights(assigned: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("funnel_stage").orderBy(F.desc("topic_weight"), F.desc("stage_confidence"), "topic_id")
    top = assigned.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    label = F.when(T.strip(F.col("topic_label_llm")) != "", F.col("topic_label_llm")).otherwise(F.col("topic_label_refined"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_r", c.alias("v")))), lambda x: x["v"])
    heads = top.groupBy("funnel_stage").agg(F.array_join(in_order(label), " || ").alias("top_topics"), F.array_join(in_order(F.col("combined_text")), " ").alias("_text"))
    terms = common_terms(top, "combined_text", ["funnel_stage"]).groupBy("funnel_stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_terms"))
    totals = assigned.groupBy("funnel_stage").agg(
        F.count("*").alias("n_topics_in_stage"), F.sum("topic_weight").alias("weighted_topics"), F.avg("stage_confidence").alias("avg_confidence"), F.avg("negative_signal_score").alias("avg_negative_signal")
    )
    d = totals.join(heads, "funnel_stage").join(terms, "funnel_stage", "left").withColumn("_terms", F.coalesce("_terms", F.array().cast("array<string>")))
    need = friction(F.col("funnel_stage"), F.col("_text"))
    told = F.concat(by_stage(F.col("funnel_stage"), R.IMPLICATIONS, F.lit(None).cast("string")), F.array_join(F.slice("_terms", 1, 4), ", "))
    return d.select(
        "funnel_stage", "top_topics", F.array_join("_terms", ", ").alias("common_signals"), need.alias("core_friction_or_need"), F.coalesce(told, need).alias("business_implication"),
        "n_topics_in_stage", "weighted_topics", "avg_confidence", "avg_negative_signal",
    )


def pain_scores() -> Column:
    """Pain points of a topic, best first: structs of score, severity, order, code, name, hits, matched, response.
    ``combined_text`` is clean already."""
    text, stage = F.col("combined_text"), F.col("funnel_stage")
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")

    def rule(k, p):
        return F.struct(F.lit(p.severity).alias("severity"), F.lit(-k).alias("order"), F.lit(p.code).alias("code"), F.lit(p.name).alias("name"), words(p.stages).alias("stages"), words(p.keywords).alias("words"), F.lit(p.response).alias("response"))

    def scored(p, matched, bonus):
        score = (F.size(matched) + bonus).cast("double").alias("score")
        return F.struct(score, p["severity"].alias("severity"), p["order"].alias("order"), p["code"].alias("code"), p["name"].alias("name"), F.size(matched).alias("hits"), matched.alias("matched"), p["response"].alias("response"))

    found = lambda p: F.filter(p["words"], lambda w: F.contains(text, w))
    hint = lambda p: F.when(F.array_contains(p["stages"], stage), 0.75).otherwise(0.0)
    every = F.transform(F.array(*[rule(k, p) for k, p in enumerate(R.PAINS)]), lambda p: scored(p, found(p), hint(p)))
    some = F.sort_array(F.filter(every, lambda p: p["score"] > 0), asc=False)
    general = F.transform(F.array(rule(99, R.GENERAL)), lambda p: scored(p, p["words"], F.lit(0.5)))
    return F.when(F.size(some) > 0, some).otherwise(general)


def with_pains(assigned: DataFrame) -> DataFrame:
    return assigned if "_all" in assigned.columns else assigned.withColumn("_all", pain_scores())


def evidence(text: Column, words: Column, most: int = 220) -> Column:
    """From 70 characters before the first listed word found to 120 behind it; else the text's beginning."""
    word = F.try_element_at(F.filter(words, lambda w: F.contains(text, w)), F.lit(1))
    at = F.call_function("locate", word, text)
    start = F.greatest(F.lit(0), at - 1 - 70)
    part = T.strip(F.substring(text, start + 1, F.least(F.length(text), at - 1 + F.length(word) + 120) - start))
    return F.when(word.isNotNull(), T.truncate(part, most, "...")).otherwise(F.substring(text, 1, most))


def pain_points(assigned: DataFrame, k: int = 3) -> DataFrame:
    p = F.col("_p")
    d = with_pains(assigned).withColumn("_p", F.explode(F.slice("_all", 1, k)))
    opportunity = F.round(F.col("topic_weight") * (1 + p["score"]) * (1 + F.col("negative_signal_score")) * (1 + F.col("question_signal_score")), 4)
    return d.select(
        "topic_id", "topic_label_llm", "funnel_stage", "topic_weight", "stage_confidence", p["code"].alias("pain_point_code"), p["name"].alias("pain_point_name"), p["hits"].alias("pain_keyword_hits"),
        p["score"].alias("pain_score"), p["severity"].alias("pain_severity"), "negative_signal_score", "question_signal_score", opportunity.alias("opportunity_score"),
        evidence(F.col("combined_text"), p["matched"]).alias("evidence_snippet"), p["response"].alias("suggested_response"),
    )


def priority(c: Column) -> Column:
    out = F.lit(R.PRIORITY_OTHER)
    for least, said in reversed(R.PRIORITIES):
        out = F.when(c >= least, said).otherwise(out)
    return out


def pain_summary(pains: DataFrame, n: int | None = 5) -> DataFrame:
    g = pains.groupBy("funnel_stage", "pain_point_name").agg(
        F.count_distinct("topic_id").alias("n_topic_hits"), F.sum("topic_weight").alias("weighted_volume"), F.avg("pain_score").alias("avg_pain_score"), F.avg("negative_signal_score").alias("avg_negative_signal"),
        F.avg("question_signal_score").alias("avg_question_signal"), F.round(F.sum("opportunity_score"), 4).alias("opportunity_score"),
    )
    rank = F.dense_rank().over(Window.partitionBy("funnel_stage").orderBy(F.desc("opportunity_score")))
    g = g.withColumns({"rank_within_stage": rank.cast("double"), "priority_flag": priority(F.col("opportunity_score"))})
    return g if n is None else g.filter(F.col("rank_within_stage") <= n)


def pain_insights(pains: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("funnel_stage").orderBy(F.desc("opportunity_score"), "pain_point_name")
    top = pain_summary(pains, n).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(c).alias("v")))), lambda x: x["v"])
    g = top.groupBy("funnel_stage").agg(in_order("pain_point_name").alias("_n"), in_order("priority_flag").alias("_f"), F.sum("opportunity_score").alias("stage_opportunity_score"))
    focus = F.concat(by_stage(F.col("funnel_stage"), R.FOCUS, R.FOCUS_OTHER), F.array_join(F.slice("_n", 1, 3), ", "))
    return g.select("funnel_stage", F.array_join("_n", " || ").alias("top_pain_points"), F.array_join("_f", " || ").alias("top_priority_flags"), "stage_opportunity_score", focus.alias("recommended_focus"))


def signal_snippets(text: Column, most: int = 5) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + R.SNIPPETS), F.lit(0))
    return F.array_join(F.slice(F.array_distinct(found), 1, most), ", ")


def deep_dive(assigned: DataFrame) -> DataFrame:
    text, first = F.col("combined_text"), F.element_at("_all", 1)
    return with_pains(assigned).select(
        "topic_id", "topic_label_llm", "funnel_stage", "topic_weight", "stage_confidence", signal_snippets(text).alias("decision_signals"), by_text(text, R.NEEDS, R.NEED_OTHER).alias("customer_need"),
        by_text(text, R.BARRIERS, R.BARRIER_OTHER).alias("purchase_barrier"), first["name"].alias("primary_pain_point"), first["score"].alias("primary_pain_score"),
        by_stage(F.col("funnel_stage"), R.ACTIONS, R.ACTION_OTHER).alias("suggested_action"),
    )


def analyze(df: DataFrame, weight: str | None = None, exclude_outliers: bool = True, n_topics: int = 3, k_pains: int = 3) -> dict[str, DataFrame]:
    """The seven tables by name; persist what the caller reads more than once."""
    assigned = assign_texts(df, weight, exclude_outliers)
    pains = pain_points(assigned, k_pains)
    return {
        "topic_stage_mapping": assigned.drop("_all"), "stage_summary": stage_summary(assigned), "stage_insights": stage_insights(assigned, n_topics), "topic_deep_dive": deep_dive(assigned),
        "pain_point_table": pains, "pain_point_summary": pain_summary(pains), "pain_point_insights": pain_insights(pains),
    }
