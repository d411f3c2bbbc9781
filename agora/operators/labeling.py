"""Labels from an external labeler: prompts, a rate limiter, tolerant parsing.

A labeler is any callable from a prompt to a reply; ``stub`` is the offline default.
Topics are few (hundreds). The limiter is one clock for all, with its log on the
driver's disk, so limited calls are made by the driver, one after another.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from agora.config import LabelerConfig
from agora.functions import text as T

DAY_S = 86_400


class CallLog:
    """Times of calls in a JSON file; an unreadable file counts as empty."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> list[float]:
        try:
            return [float(x) for x in json.loads(self.path.read_text())]
        except (OSError, ValueError, TypeError):
            return []

    def save(self, times: list[float]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(times))


class RateLimiter:
    """Waits for the least interval; raises when a day's calls are spent. Calls are logged before they are made."""

    def __init__(self, cfg: LabelerConfig = LabelerConfig(), log: CallLog | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.cfg, self.log, self.clock, self.sleep = cfg, log, clock, sleep
        self.times: list[float] = log.load() if log else []

    def acquire(self) -> None:
        now = self.clock()
        self.times = [t for t in self.times if now - t < DAY_S]
        if len(self.times) >= self.cfg.calls_per_day:
            raise RuntimeError(f"{self.cfg.calls_per_day} calls within 24 hours; wait {DAY_S - (now - self.times[0]):.0f} s")
        if self.times and (wait := self.cfg.min_interval_s - (now - self.times[-1])) > 0:
            self.sleep(wait)
        self.times.append(self.clock())
        if self.log:
            self.log.save(self.times)


def prompt(cfg: LabelerConfig = LabelerConfig()) -> Column:
    """The request for one topic, from its words and its two representative texts."""
    cut = lambda c: T.truncate(F.coalesce(F.col(c), F.lit("")), cfg.max_chars)
    return F.concat(
        F.lit("Name the topic of a discussion and sum it up in one sentence. Reply with a JSON object with the keys topic_label_llm and topic_summary_llm.\nWords: "),
        F.coalesce("topic_label_bert", F.lit("")), F.lit("\nLabel so far: "), F.coalesce("topic_label_refined", F.lit("")), F.lit("\nTypical text: "), cut("rep_doc_centroid"),
        F.lit("\nUntypical text: "), cut("rep_doc_farthest"),
    )


def stub(request: str) -> str:
    """A reply made of the request itself."""
    lines = dict(x.split(": ", 1) for x in request.split("\n") if ": " in x)
    name = lines.get("Label so far") or lines.get("Words") or "Unnamed"
    return json.dumps({"topic_label_llm": name, "topic_summary_llm": f"Discussion about {name}."})


def call(df: DataFrame, labeler: Callable[[str], str] = stub, limiter: RateLimiter | None = None, column: str = "prompt", key: str = "topic_id") -> DataFrame:
    """``reply`` to each prompt. With a limiter the driver asks, topic by topic; its daily limit bounds their number."""
    if limiter:
        replies = []
        for r in df.select(key, column).orderBy(key).toLocalIterator():
            limiter.acquire()
            replies.append((r[key], labeler(r[column])))
        known = P.StructType([P.StructField("_key", df.schema[key].dataType), P.StructField("reply", P.StringType())])
        return df.join(df.sparkSession.createDataFrame(replies, known), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    schema = P.StructType([*df.schema.fields, P.StructField("reply", P.StringType())])

    def run(frames):
        for f in frames:
            f["reply"] = [labeler(p) for p in f[column]]
            yield f

    return df.mapInPandas(run, schema)


def find(name: str) -> Callable[[str], str]:
    """A labeler by name: ``stub``, or ``module:function`` for a backend of one's own."""
    if name == "stub":
        return stub
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function or "label", None)
    if not callable(found):
        raise ValueError(f"no labeler {name!r}")
    return found


def parse(reply: Column) -> tuple[Column, Column]:
    """(label, summary): of a JSON object, else the raw reply and an empty summary."""
    body = F.regexp_replace(T.strip(F.coalesce(reply, F.lit(""))), r"(?s)^```(?:json)?\s*|\s*```$", "")
    is_object = body.rlike(r"(?s)^\{.*\}$") & F.get_json_object(body, "$").isNotNull()
    value = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit(""))
    return F.when(is_object, value("topic_label_llm")).otherwise(T.strip(reply)), F.when(is_object, value("topic_summary_llm")).otherwise("")


def label_topics(topics: DataFrame, labeler=stub, limiter=None, cfg: LabelerConfig = LabelerConfig()) -> DataFrame:
    d = call(topics.withColumn("prompt", prompt(cfg)), labeler, limiter)
    name, summary = parse(F.col("reply"))
    return d.withColumns({"topic_label_llm": name, "topic_summary_llm": summary}).select(
        "topic_id", "doc_count", "topic_label_bert", "topic_label_refined", "rep_doc_centroid", "rep_doc_farthest", "topic_label_llm", "topic_summary_llm"
    )


def calls_in_day(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``calls_24h``: how many rows of the key lie within 24 hours up to each row, as the limiter counts them."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-DAY_S * 1_000_000 + 1, 0)
    return df.withColumn("calls_24h", F.count("*").over(w))
