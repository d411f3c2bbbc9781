"""Toxicity scores from a weighted lexicon.

Folding: lower case; invisible characters and combining marks are deleted; look-alike
letters of other scripts and digits or signs used as letters become plain letters.
For words of the base list a second reading also takes the marks off letters and
``1`` and ``|`` as l. Past the deletions folding is one character to one, so matches
can be checked against the unfolded text: a match needs a letter there, no letter in
front, and a whole-word entry also none behind. Matches inside an exception phrase
don't count. All entries and exceptions are found in one Aho-Corasick pass, or in two
where the second reading differs. A text's evidence is the weight of its matches
per hundred words, and a logistic curve turns it into a score; with no match, as
for an empty or null text, the score is the curve's value at no evidence.

Entries are words (``idiot$``) or beginnings of words (``idio``). ``learn`` weighs
a base list and finds further entries in labelled documents: features of toxic
documents whose log-odds are high. A feature's support is counted in distinct
sketches of documents, so a group of near copies can't make its own words toxic.
At most ``most`` labelled rows are read, those with the smallest hash of their id.

Each row is scored by itself: repeated rows, and texts that tie, get one score each,
an empty table no rows, and a text of any length is read whole. Other columns of the
input, whatever their names, take no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon is learned from at most.
MOST_ROWS = 12_000
#: Entries at most, least log-odds, and least share of toxic sketches.
MOST_ENTRIES, LEAST_ODDS, LEAST_SHARE, LEAST_SKETCHES = 2_000, 3.0, 0.01, 5
PRIOR_WEIGHT, MOST_WEIGHT = 2.0, 6.0
STEM_LENGTHS = (4, 5, 6, 7, 8)

# A base list, exception phrases, and what look-alike characters stand for.
BASE = (
    "idiot idiots stupid moron morons scum trash loser losers clown pathetic disgusting worthless dumbass asshole assholes bastard bastards "
    "bitch bitches bullshit cretin dickhead douchebag dumb fuck fucker fucking imbecile jackass motherfucker retard retarded shit shithead "
    "slut sluts whore whores twat wanker vermin subhuman lowlife scumbag garbage filth halfwit nitwit"
).split()
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "clown car", "circus clown", "garbage collection", "garbage collector", "garbage truck", "pond scum", "sore loser", "dumb waiter", "dumb bell", "dumb terminal", "shit happens", "rodeo clown")
LOOK_ALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ɡ": "g", "һ": "h", "і": "i", "ı": "i", "ι": "i", "ј": "j",
    "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t",
    "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ѡ": "w", "ԝ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "l", "¡": "i",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Letters that Unicode takes apart into a plain letter and marks, in the blocks of extended Latin.
MARKED = {chr(c): d[0].lower() for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", chr(c)))[0].isascii() and len(d) > 1}
_FOLD = str.maketrans({**LOOK_ALIKES, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)}})
#: Another reading, for the base list only: learned entries are told apart by their marks.
_FOLD_MORE = {**{ord(c): by for c, by in MARKED.items()}, **_FOLD, ord("1"): "l", ord("|"): "l"}
_BASE_WORDS = frozenset(BASE)
_DELETED = re.compile(f"[{INVISIBLE}\u0300-\u036f]")
_MORE = re.compile(r"[^\W\d_][1|]|[1|][^\W\d_]|[" + "".join(MARKED) + "]")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    return _DELETED.sub("", text.lower())


def fold(text: str) -> str:
    return plain(text).translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (a word ends in ``$``, a beginning of words doesn't), and the curve."""

    weights: dict[str, float]
    slope: float = 4.0
    middle: float = 1.5
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0, True, None))
        for entry, weight in self.weights.items():
            word = entry.rstrip("$")
            whole = entry.endswith("$")
            old = a.get(word, None)
            if old is None or old[3] is not None and old[1] < weight:
                a.add_word(word, (len(word), weight, whole, entry))
        a.make_automaton()
        return a


def evidence(text: str, automaton) -> tuple[float, int]:
    """(weight per hundred words, matches). Of entries that begin at one place the heaviest counts."""
    lower = plain(text)
    skip: list[tuple[int, int]] = []
    best: dict[int, tuple[float, int]] = {}
    n = len(lower)
    for table in (_FOLD, _FOLD_MORE) if _MORE.search(lower) else (_FOLD,):
        for end, (length, weight, whole, entry) in automaton.iter(lower.translate(table)):
            start = end + 1 - length
            if start and lower[start - 1].isalpha() or whole and end + 1 < n and lower[end + 1].isalpha():
                continue
            if table is _FOLD_MORE and entry is not None and entry.rstrip("$") not in _BASE_WORDS:
                continue
            if entry is None:
                skip.append((start, end))
            elif any(map(str.isalpha, lower[start : end + 1])) and weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, end)
    kept = [w for s, (w, e) in best.items() if not any(a <= s and e <= b for a, b in skip)]
    return 100.0 * sum(kept) / (len(lower.split()) + 20), len(kept)


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _features(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= STEM_LENGTHS[0] and not w.isdigit():
            out.add(w + "$")
            for k in STEM_LENGTHS:
                if len(w) > k:
                    out.add(w[:k])
    return out


def _sketch(text: str) -> int:
    """One min-hash over the words of a text: near copies mostly share it."""
    import xxhash

    return min((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in {x for x in text.lower().split() if len(x) > 5}), default=0)


def _supports(rows: DataFrame, chosen: list[str] | None) -> DataFrame:
    """Documents' features with the number of distinct sketches: (feature, n)."""
    wanted = None if chosen is None else frozenset(chosen)

    def run(batches):
        import pandas as pd

        seen = set()
        for b in batches:
            for text in b["text"]:
                k = _sketch(text)
                seen.add(("", k))
                found = _features(text)
                seen.update((f, k) for f in (found if wanted is None else found & wanted))
        yield pd.DataFrame(list(seen), columns=["feature", "sketch"])

    return rows.select("text").mapInPandas(run, "feature string, sketch bigint").distinct().groupBy("feature").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_column: str = "doc_id", label_column: str = "toxic") -> Lexicon:
    """A lexicon from labelled documents; with none of either kind, the base list at its prior weight.

    ``labels`` holds the rows to learn from. Rows with a null id or label are left out, and of
    several labels for one id the smallest is used.
    """
    base = {w + "$": PRIOR_WEIGHT for w in BASE}
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most)
    # the sample's size is bounded by ``most``: small ids and labels only
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("text", "y").persist()
    try:
        toxic, clean = rows.filter("y = 1"), rows.filter("y = 0")
        found = _supports(toxic, None)
        n_toxic = next((r.n for r in found.filter("feature = ''").collect()), 0)
        if not n_toxic:
            return Lexicon(base)
        least = max(LEAST_SKETCHES, math.ceil(LEAST_SHARE * n_toxic))
        listed = found.filter((F.col("n") >= least) & (F.col("feature") != "")).orderBy(F.desc("n"), "feature").limit(20 * MOST_ENTRIES)
        support = {r.feature: r.n for r in listed.collect()}
        against = {r.feature: r.n for r in _supports(clean, [*support, *base]).collect()}
        n_clean = against.get("", 0)
        odds = lambda f: math.log((support.get(f, 0) + 0.5) / (n_toxic + 1)) - math.log((against.get(f, 0) + 0.5) / (n_clean + 1))
        # a beginning that one longer entry nearly always follows says no more than that entry
        longer: dict[str, int] = {}
        for f in support:
            for k in range(STEM_LENGTHS[0], len(f)):
                longer[f[:k]] = max(longer.get(f[:k], 0), support[f])
        good = [f for f in support if odds(f) >= LEAST_ODDS and longer.get(f, 0) * 1.05 < support[f]]
        weights: dict[str, float] = {}
        for f in sorted(sorted(good, key=lambda f: (-support[f], f))[:MOST_ENTRIES], key=len):
            # nor does an entry beside a beginning of it that weighs as much
            if not any(weights.get(f[:k], 0.0) + 0.5 >= odds(f) for k in range(STEM_LENGTHS[0], len(f))):
                weights[f] = min(MOST_WEIGHT, odds(f))
        for f, w in base.items():
            if f not in weights and against.get(f, 0) <= 0.001 * (n_clean + 1):
                weights[f] = w
        return _fit(rows, Lexicon(weights))
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The curve over the sample's evidence (at most ``most`` numbers): logistic regression on one variable."""
    import numpy as np

    def run(batches):
        import pandas as pd

        a = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame({"x": [evidence(t, a)[0] for t in b["text"]], "y": b["y"]})

    got = rows.mapInPandas(run, "x double, y int").toPandas()
    x, y = np.log1p(got["x"].to_numpy(float)), got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return lexicon
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a, b, penalty = 1.0, 0.0, 0.05
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * w * x).sum() + penalty * a, ((p - y) * w).sum() + penalty * b])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + penalty, (v * x).sum()], [(v * x).sum(), v.sum() + penalty]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, float(a), float(-b / a) if a > 1e-6 else 1.0, lexicon.exceptions)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (id, score, predicted, n_matches)."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        a = lexicon.automaton()
        for batch in batches:
            found = [evidence(t, a) for t in batch.column(1).to_pylist()]
            scores = [logistic(lexicon.slope * (math.log1p(x) - lexicon.middle)) for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["id", "score", "predicted", "n_matches"])

    return source.mapInArrow(run, f"id {kind}, score double, predicted int, n_matches bigint").withColumnRenamed("id", id_column)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; the lexicon is learned from labels outside the held-out fold."""
    from agora.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold_of = F.crc32(F.col("doc_id").cast("string")) % 3
    lexicon = learn(docs, labels.filter(fold_of != 1))
    return score(docs, lexicon).withColumn("held_out", fold_of == 1).select("doc_id", "held_out", "score", "predicted", "n_matches")
