"""Sources and sinks of the forum tables.

Files are discovered and read by Spark's readers in one scan for all of them; the
prefix in a file's name says which group it belongs to.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from agora.operators import canonical

# Texts that stand for a missing value in CSV files.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SUBMISSIONS = P.StructType([P.StructField(c, P.StringType()) for c in ("author", "title", "text", "created", "score", "link", "url")])
COMMENTS = P.StructType([P.StructField(c, P.StringType()) for c in ("author", "body", "created", "score", "link")])
MODES = ("all", "submissions", "comments")


def read_csv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All columns as text, missing-value texts as null; quoted fields may hold line breaks."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.csv(path)
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NA), F.col(f"`{c}`")) for c in df.columns})


def prefix(suffix: str) -> Column:
    """The part of the file's name before the suffix."""
    return F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix}\.csv$", 1)


def read_files(spark: SparkSession, folder: str, suffix: str, schema: P.StructType) -> DataFrame:
    """Files ``<prefix><suffix>.csv`` of a folder with subreddit, the schema's columns, and _file and _row_idx for
    order: rows are numbered as they are read, and a file is read by one task. No file: no rows."""
    try:
        df = read_csv(spark, folder, f"*{suffix}.csv")
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumns({"subreddit": F.lit(""), "_file": F.lit(""), "_row_idx": F.lit(0).cast("bigint")})
    if not df.columns:
        return spark.createDataFrame([], schema).withColumns({"subreddit": F.lit(""), "_file": F.lit(""), "_row_idx": F.lit(0).cast("bigint")})
    have = [F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in schema]
    return df.select(*have, prefix(suffix).alias("subreddit"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row_idx"))


def parse_tags(items: list[str]) -> dict[str, str]:
    """``name=tag`` items, names in lower case."""
    out = {}
    for item in items or []:
        k, eq, v = item.partition("=")
        if not eq or not k.strip() or not v.strip():
            raise ValueError(f"not name=tag: {item!r}")
        out[k.strip().lower()] = v.strip()
    return out


def source_tag(name: Column, tags: dict[str, str]) -> Column:
    low = F.lower(name)
    if not tags:
        return low
    lookup = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, low), low)


def parse_targets(items: list[str]) -> list[str]:
    """Names between commas and spaces, each once, in order."""
    found = [x.strip() for item in items or [] for x in item.replace(",", " ").split()]
    return list(dict.fromkeys(x for x in found if x))


def choose_targets(df: DataFrame, targets: list[str], column: str = "subreddit") -> DataFrame:
    """Rows of the targets, whatever their case; an error names targets that no row has."""
    low = [t.lower() for t in targets]
    d = df.filter(F.lower(column).isin(*low))
    have = {r[0] for r in d.select(F.lower(column)).distinct().limit(len(low) + 1).collect()}
    missing = [t for t in targets if t.lower() not in have]
    if missing:
        raise ValueError(f"no files for: {', '.join(missing)}")
    return d


def paired_comments(comments: DataFrame, submissions: DataFrame, column: str = "subreddit") -> DataFrame:
    """Comments of groups that have submissions."""
    keys = submissions.select(F.lower(column).alias("_k")).distinct()
    return comments.join(keys, F.lower(comments[column]) == F.col("_k"), "left_semi")


def gather(spark: SparkSession, folder: str, tags: dict[str, str] | None = None, targets: list[str] | None = None, mode: str = "all", submissions: str = "_submissions_ev", comments: str = "_comments_ev") -> DataFrame:
    """Canonical raw rows of all files of a folder, with ``_file_idx`` and ``_row_idx`` as their order."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    parts = []
    s, c = read_files(spark, folder, submissions, SUBMISSIONS), read_files(spark, folder, comments, COMMENTS)
    if mode == "all":
        c = paired_comments(c, s)
    for kind, df, project in ((0, s, canonical.from_submissions), (1, c, canonical.from_comments)):
        if mode == "all" or (mode == "submissions") == (kind == 0):
            d = choose_targets(df, targets) if targets and (kind == 0 or mode == "comments") else df.filter(F.lower("subreddit").isin(*[t.lower() for t in targets])) if targets else df
            d = d.withColumn("source_tag", source_tag(F.col("subreddit"), tags or {}))
            parts.append(project(d).withColumn("_file_idx", F.lower("subreddit")).withColumn("_kind", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if out.isEmpty():
        raise FileNotFoundError(f"no rows of {mode} in {folder}")
    return out


# embeddings


def embedding_key(text: Column, model: str, version: str = "v1") -> Column:
    """Content address of a text's embedding: hashes of version, model and text."""
    h = lambda v: F.sha1(F.lit(v))
    return F.concat_ws("_", F.substring(h(version), 1, 8), F.substring(h(model), 1, 10), F.sha1(text))


def split_cache(docs: DataFrame, cache: DataFrame, text: str, model: str, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(documents with cached embeddings, documents without)."""
    keyed = docs.withColumn("cache_key", embedding_key(F.col(text), model, version))
    known = cache.select(F.col("cache_key").alias("_k"), "embedding")
    hits = keyed.join(known, F.col("cache_key") == F.col("_k")).drop("_k")
    return hits, keyed.join(known, F.col("cache_key") == F.col("_k"), "left_anti")


def save_embeddings(df: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def alignment(docs: DataFrame, embeddings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(missing_embeddings, missing_documents): keys that only one side has."""
    a, b = docs.select(key).distinct(), embeddings.select(key).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing_embeddings"), F.count_if(F.col("_a").isNull()).alias("missing_documents"))


def check_alignment(docs: DataFrame, embeddings: DataFrame, key: str = "doc_id") -> None:
    r = alignment(docs, embeddings, key).first()
    if r[0] or r[1]:
        raise ValueError(f"{r[0]} documents lack embeddings, {r[1]} embeddings lack documents")


# sinks


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Arrays go into CSV files as JSON."""
    if kind == "csv":
        df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))})
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def write_workbook(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
    """A folder for each named table."""
    out = []
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", kind)
        out.append(f"{folder.rstrip('/')}/{name}")
    return out


def must_exist(*paths: str) -> None:
    for p in paths:
        if "://" not in p and not Path(p).exists():
            raise FileNotFoundError(p)
