"""Exact token counts by dynamic programming over prefixes.

``count[p] = count[p - len(last token)] + cost(last token)`` gives the exact token
count of every prefix of a word (``prefix_bpe`` finds the last tokens). Pieces of
this vocabulary hold a space only in front, so a text's count is the sum over its
stretches "spaces, then non-spaces". The counts at all prefixes of a stretch are
kept, so a text's count is a sum of their ends, and the longest prefix within a
budget is found in the one stretch in which the running sum meets it: budget and
truncation questions need no encoding.

Null texts count as empty (0 tokens, 0 bytes). Characters outside the vocabulary
cost one token for each UTF-8 byte. Rows are kept as they are, repeated ones too.
A text of any length is counted whole; memory grows with the batch and the
bounded cache of stretches.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.bpe import CACHE_WORDS, slices
from agora.llm.common import per_worker
from agora.llm.prefix_bpe import read_piece_vocabulary

#: Stretches that can be counted alone: spaces with the word after them, or trailing spaces.
_STRETCHES = re.compile("▁*[^▁]+|▁+")


class PrefixCounter:
    def __init__(self, path: str):
        self.bpe = read_piece_vocabulary(path)
        #: The counts at all prefixes of a stretch, the empty one first.
        self.cache: dict[str, bytes | array] = {}
        self.older: dict[str, bytes | array] = {}
        self.costs: dict[str, int] = {}

    def cost(self, token: str) -> int:
        """Tokens for a character that the vocabulary lacks."""
        if token not in self.costs:
            if len(self.costs) > CACHE_WORDS:
                self.costs = {}
            self.costs[token] = len(token.encode("utf-8", "surrogatepass"))
        return self.costs[token]

    @staticmethod
    def stretches(text: str) -> list[str]:
        return _STRETCHES.findall("▁" + text.replace(" ", "▁")) if text else []

    def learn(self, stretches: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        missing = stretches - self.cache.keys()
        for w in missing & self.older.keys():
            self.cache[w] = self.older[w]
        missing -= self.older.keys()
        #: The counts of the trie's current path; a shared prefix keeps its own.
        counts, tokens = [0], self.bpe.tokens
        for word, last, shared in self.bpe.walk(missing):
            del counts[shared + 1 :]
            for end in range(shared + 1, len(last)):
                t = last[end]
                counts.append(counts[end - len(t)] + (1 if t in tokens else self.cost(t)))
            try:
                self.cache[word] = bytes(counts)
            except ValueError:  # a count over 255
                self.cache[word] = array("Q", counts)
            before = word

    def counts(self, texts: list[str], budget: int | None = None) -> tuple[list[int], list[int]]:
        """The texts' token counts, and with a budget the longest prefixes of at most that many tokens."""
        split = [self.stretches(t) for t in texts]
        self.learn(set().union(*split))
        known = self.cache
        counts = [sum([known[x][-1] for x in s]) for s in split]
        if budget is None:
            return counts, []
        return counts, [len(t) if n <= budget else self._cut(s, budget) for t, s, n in zip(texts, split, counts, strict=True)]

    def at_every_prefix(self, text: str) -> list[int]:
        """The token count of text[:p] for every p."""
        out, s = [0], self.stretches(text)
        self.learn(set(s))
        for x in s:
            before = out[-1]
            out += [before + n for n in self.cache[x][1:]]
        return [0, *out[2:]]

    def longest_prefix(self, text: str, budget: int) -> int:
        """The greatest p for which text[:p] has at most ``budget`` tokens."""
        return self.counts([text], budget)[1][0]

    def _cut(self, stretches: list[str], budget: int) -> int:
        """Where a text over the budget is cut: every stretch costs a token at least, so the budget is met within as many
        stretches, and none after that one has room. Within it counts may fall, so its end comes first."""
        ends = list(accumulate([self.cache[x][-1] for x in stretches[: budget + 1]]))
        k = bisect_left(ends, budget)
        if k < len(ends) and ends[k] == budget:
            k += 1
        room, inside = budget - (ends[k - 1] if k else 0), self.cache[stretches[k]]
        within = next(p for p in range(len(inside) - 1, -1, -1) if inside[p] <= room)
        # the text's first stretch begins with a space that the text doesn't have
        return max(0, sum(map(len, stretches[:k])) + within - 1)

    def boundaries(self, text: str) -> list[int]:
        """Running token counts at the ends of the stretches, enough to place chunks of a text."""
        s = self.stretches(text)
        self.learn(set(s))
        return list(accumulate(self.cache[x][-1] for x in s))


_counters: dict[str, PrefixCounter] = per_worker()


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_column: str = "doc_id", text_column: str = "text", with_cut: bool = False) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit), and with ``with_cut`` also
    ``cut`` (characters of the longest prefix within ``limit`` tokens)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "n_tokens", "over_limit", *["cut"] * with_cut]

    def run(batches):
        import pyarrow as pa

        c = counter(vocabulary)
        for batch in batches:
            for a, b, texts in slices(batch.column(2)):
                n, cuts = c.counts(texts, limit if with_cut else None)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                if with_cut:
                    columns.append(pa.array(cuts, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", cut bigint" * with_cut
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document under the piece vocabulary, and where a window of 4,096 tokens cuts it."""
    import public_tokenizers

    from agora.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096, with_cut=True)
