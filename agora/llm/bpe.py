"""BPE encoding and decoding of whole texts.

Per task the distinct words of a batch go into a trie that is walked depth first
(``prefix_bpe``); each word's ids are then kept as packed bytes, up to
``CACHE_WORDS`` in each of two generations, and texts are put together from them
and decoded from their ids. White space separates words in this vocabulary and is
dropped, so no word's encoding depends on its neighbours.

Null texts count as empty; an empty text has no ids and decodes to "". Strings
of special tokens inside a text are those tokens, as the vocabulary's library
reads them. Rows are kept as they are, repeated ones too. A text of any length
is encoded whole; memory grows with the batch and the bounded word cache.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import forget, per_worker, trimmed
from agora.llm.prefix_bpe import END, PrefixBPE, read_word_vocabulary

#: Distinct words of a generation: beyond it, a worker starts the next one and drops the one before.
CACHE_WORDS = 300_000

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The vocabulary's word pattern over lower-cased Latin-1, where letters and digits are known.
_LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha())
_DIGITS = "".join(chr(c) for c in range(256) if chr(c).isnumeric())
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


class WordEncoder:
    """Encodes and decodes with a lower-casing, white-space-dropping word vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe: PrefixBPE
        self.bpe, self.alphabet, self.special = read_word_vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.bpe.tokens.items()}
        self.shown = {i: self.show(t) for t, i in self.bpe.tokens.items()} | {i: t for t, i in self.special.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def show(self, token: str) -> str:
        c = ord(token[-1])
        return token[:-1] + chr(c - END) + "</w>" if c >= END else token

    def pieces(self, chunk: str) -> list[str]:
        """The vocabulary's words in a stretch without white space, as byte characters with their end."""
        try:
            raw = chunk.encode("latin-1")
        except UnicodeEncodeError:
            return [w[:-1] + chr(ord(w[-1]) + END) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        lower, out = chunk.lower(), []
        for w in _WORDS.findall(lower):
            shown = w if raw.isascii() and w.isprintable() else "".join(self.alphabet[b] for b in w.encode())
            out.append(shown[:-1] + chr(ord(shown[-1]) + END))
        return out

    def learn(self, chunks: set[str]) -> None:
        parts, packed = {c: self.pieces(c) for c in chunks}, self.packed
        encoded = {}
        for word, last, _ in self.bpe.walk(w for ws in parts.values() for w in ws):
            encoded[word] = b"".join([packed[t] for t in self.bpe.chain(last)])
        for c, ws in parts.items():
            self.cache[c] = encoded[ws[0]] if len(ws) == 1 else b"".join([encoded[w] for w in ws])

    def chunks(self, text: str) -> list[str]:
        return (_SPACES.split(text) if _SEPARATORS.search(text) else text.split()) if text else []

    def split(self, text: str) -> list[str]:
        """Stretches without white space, with special tokens as stretches of their own."""
        if self.specials is None or not self.specials.search(text):
            return self.chunks(text)
        return [c for k, part in enumerate(self.specials.split(text)) for c in ([part] if k % 2 else self.chunks(part))]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        known = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        words = set().union(*split)
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        missing = words - self.cache.keys() - known.keys() - {""}
        for w in missing & self.older.keys():
            self.cache[w] = self.older[w]
        self.learn(missing - self.older.keys())
        cache = self.cache | known if any(t in known for s in split for t in s) else self.cache
        ids_of, shown_of = cache.__getitem__, self.shown.__getitem__
        for words in split:
            ids = b"".join(map(ids_of, filter(None, words)))
            tokens = array("I", ids)
            if sys.byteorder == "big":
                tokens.byteswap()
            yield ids, " ".join(map(shown_of, tokens))


_encoders: dict[str, WordEncoder] = per_worker()


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(texts, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive texts of an Arrow column, about ``most`` bytes together and one text at least, with their range."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += n or 0
        if held >= most or k == len(texts):
            yield start, k, texts.slice(start, k - start).to_pylist()
            start, held = k, 0


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True, reuse: bool = True, digests: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, columns ``keep``, n_tokens, and ids, decoded text, digests or ids with digests.

    With ``with_ids`` the columns are (id, n_tokens, ids array<int>, decoded string);
    without, (id, n_tokens, ids_sha256, decoded_sha256); with both ``with_ids`` and ``digests``
    (id, n_tokens, ids, ids_sha256, decoded_sha256). Names in ``keep`` differ from these. With ``reuse`` a Python worker keeps encoder
    and words for its next task; without, they end with the task, for jobs with more workers than cores.
    """
    digests = not with_ids if digests is None else digests
    source = docs.select(F.col(f"`{id_column}`").alias("id"), *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"))
    kept = len(source.columns) - 1
    tail = ["ids array<int>"] * with_ids + (["ids_sha256 string", "decoded_sha256 string"] if digests else ["decoded string"])
    names = [*source.columns[:kept], "n_tokens", *[f.split()[0] for f in tail]]

    @trimmed
    def run(batches):
        import numpy as np
        import pyarrow as pa

        if not reuse:
            forget()
        e = encoder(vocabulary) if reuse else WordEncoder(vocabulary)
        for batch in batches:
            for a, b, texts in slices(batch.column(kept)):
                n, made = [], [[] for _ in tail]
                for ids, decoded in e.encode_texts(texts):
                    n.append(len(ids) // 4)
                    row = [np.frombuffer(ids, "<i4")] if with_ids else []
                    row += [hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] if digests else [decoded]
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                made = [pa.array(v, pa.string() if f.endswith("string") else pa.list_(pa.int32())) for f, v in zip(tail, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:kept]], pa.array(n, pa.int64()), *made], names=names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:kept]], "n_tokens bigint", *tail])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op3_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document under the word vocabulary."""
    import public_tokenizers

    from agora.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
