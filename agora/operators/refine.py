"""Readable topic labels from topic words, without any model.

Phrases are candidates in a fixed order; near-equal ones (Jaccard of canonical
tokens from 0.8) go, and the best score wins, the first of equals. All of it is a
fold over small arrays inside one row, so it needs no shuffle.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.config import RefineConfig
from agora.functions import text as T
from agora.operators.topics import stopwords

SAME = 0.8
NO_STRINGS = "array<string>"


def _parse_list(texts: pd.Series) -> pd.Series:
    """A list written as text: a literal, else parts between commas, else the text itself. For text sources only;
    inside the engine lists are arrays."""

    def one(s):
        if s is None or not s.strip():
            return []
        try:
            v = ast.literal_eval(s.strip())
            if isinstance(v, (list, tuple)):
                return [str(x) for x in v]
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
        parts = [x.strip(" []'\"") for x in (s.split(",") if "," in s else [s.strip()])]
        return [x for x in parts if x] if "," in s else parts

    return texts.map(one)


def parse_list(c: Column) -> Column:
    return F.pandas_udf(_parse_list, "array<string>")(c)


def as_list(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.array().cast(NO_STRINGS)
    return F.coalesce(F.col(name) if kind.startswith("array") else parse_list(F.col(name)), F.array().cast(NO_STRINGS))


def without_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^-?\d+_", "")


def normalize(c: Column) -> Column:
    return T.collapse(F.regexp_replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), r"[^a-z0-9\s\-+/]", " "))


def singular(t: Column) -> Column:
    n = F.length(t)
    ies = F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))
    return F.when(F.endswith(t, F.lit("ies")) & (n > 4), ies).when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")) & (n > 3), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def canonical(phrase: Column, stop: Column) -> Column:
    return F.filter(F.transform(F.split(normalize(phrase), " "), singular), lambda t: (t != "") & ~F.array_contains(stop, t))


def _stop(cfg: RefineConfig) -> Column:
    return F.array(*map(F.lit, stopwords(cfg.extra_stopwords, keep_negations=False)))


def _generic(cfg: RefineConfig) -> Column:
    return F.transform(F.array(*map(F.lit, cfg.generic_words)), singular)


def is_generic(tokens: Column, generic: Column) -> Column:
    """No tokens, or generic ones only."""
    return F.forall(tokens, lambda t: F.array_contains(generic, t))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def distinct_phrases(phrases: Column, stop: Column) -> Column:
    """Phrases with tokens whose token set is no near copy of an earlier one."""
    none = F.array().cast("array<struct<p:string,t:array<string>>>")

    def step(kept, p):
        t = canonical(p, stop)
        same = F.exists(kept, lambda k: jaccard(k["t"], t) >= SAME)
        return F.when((F.size(t) == 0) | same, kept).otherwise(F.concat(kept, F.array(F.struct(p.alias("p"), t.alias("t")))))

    return F.transform(F.aggregate(phrases, none, step), lambda k: k["p"])


def candidates(df: DataFrame, cfg: RefineConfig = RefineConfig()) -> Column:
    terms = F.filter(F.split(without_prefix(F.coalesce(F.col("Name"), F.lit(""))), "_"), lambda x: x != "")
    front = lambda a, k: F.array_join(F.slice(a, 1, k), " ")
    rep = F.filter(F.transform(F.slice(as_list(df, "Representation"), 1, 5), normalize), lambda x: x != "")
    none = F.array().cast(NO_STRINGS)
    parts = F.concat(
        F.array(front(terms, 2), front(terms, 3), front(terms, 4)), F.slice(as_list(df, "KeyBERT"), 1, 5), F.slice(as_list(df, "MMR"), 1, 5),
        F.when(F.size(rep) >= 2, F.array(front(rep, 2))).otherwise(none), F.when(F.size(rep) >= 3, F.array(front(rep, 3))).otherwise(none), F.slice(terms, 1, 4),
    )
    return distinct_phrases(F.transform(F.filter(parts, lambda x: T.strip(x) != ""), normalize), _stop(cfg))


def _score(phrase: Column, keybert: Column, mmr: Column, cfg: RefineConfig, stop: Column, generic: Column) -> Column:
    t = canonical(phrase, stop)
    n, u = F.size(t), F.size(F.array_distinct(t))
    one = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = F.when((n >= 2) & (n <= cfg.label_max_words), 4.0).when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 2.5 - F.abs(n - 3) * 0.3))
    score = score - one(is_generic(t, generic), 2.5) - one(F.exists(t, lambda x: x.rlike("[0-9]")), 1.5) + one(F.array_contains(keybert, phrase), 1.8)
    score = score + one(F.array_contains(mmr, phrase), 0.8) + u / F.greatest(F.lit(1), n) - one(u < n, 1.2)
    return F.struct(F.round(score, 9).alias("score"), (-F.abs(n - 2)).alias("near_two"), (-F.length(phrase)).alias("short"))


def label(df: DataFrame, cfg: RefineConfig = RefineConfig(), found: str = "_candidates") -> Column:
    """The label from the candidates in column ``found``."""
    stop, generic = _stop(cfg), _generic(cfg)
    keybert = F.transform(F.slice(as_list(df, "KeyBERT"), 1, 10), normalize)
    mmr = F.transform(F.slice(as_list(df, "MMR"), 1, 10), normalize)
    ranked = F.transform(F.col(found), lambda p, i: F.struct(_score(p, keybert, mmr, cfg, stop, generic).alias("s"), (-i).alias("i"), p.alias("p")))
    tokens = F.slice(canonical(F.array_max(ranked)["p"], stop), 1, cfg.label_max_words)
    named = T.title_case(F.array_join(tokens, " "))
    for plain, shown in (("Ev", "EV"), ("Phev", "PHEV"), ("Bev", "BEV"), ("Msrp", "MSRP")):
        named = F.regexp_replace(named, rf"(?U)\b{plain}\b", shown)
    number = F.concat(F.lit("Topic "), F.col("Topic").cast("string"))
    return F.when(F.col("Topic") == -1, "Outlier / Mixed").when(F.size(found) == 0, number).otherwise(F.when(F.size(tokens) > 0, named).otherwise(number))


def refine(info: DataFrame, cfg: RefineConfig = RefineConfig()) -> DataFrame:
    """The topic table with topic_label_refined, topic_keywords_clean and topic_keybert_clean; missing word columns count as empty."""
    d = info if "Name" in info.columns else info.withColumn("Name", F.lit(""))
    d = d.withColumn("_candidates", candidates(d, cfg))
    eight = lambda c: F.array_join(F.slice(as_list(info, c), 1, 8), ", ")
    return d.withColumns({"topic_label_refined": label(d, cfg), "topic_keywords_clean": eight("Representation"), "topic_keybert_clean": eight("KeyBERT")}).drop("_candidates")


def clean_representatives(info: DataFrame, column: str = "Representative_Docs") -> DataFrame:
    """Representative texts without mojibake, entities, odd quotes and extra space. Texts are exploded, so that one
    expression serves each, and put back in order by their topic."""
    if column not in info.columns:
        return info
    x = info.select("Topic", F.posexplode(as_list(info, column)).alias("_i", "_t"))
    x = x.withColumn("_t", T.collapse(T.straight(F.col("_t"))))
    back = x.groupBy(F.col("Topic").alias("_topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda e: e["_t"]).alias("_new"))
    joined = info.join(back, F.col("Topic").eqNullSafe(F.col("_topic")), "left")
    return joined.withColumn(column, F.coalesce("_new", F.array().cast(NO_STRINGS))).drop("_topic", "_new")
