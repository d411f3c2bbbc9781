"""BPE and token counts against the vocabularies' own libraries."""

import hashlib
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402
import sentencepiece  # noqa: E402

from agora.llm import bpe, token_counts  # noqa: E402

TEXTS = [
    "", " ", "a  b\n\tc", "x\x1cy\x1f z\x85q", "İstanbul ΟΔΟΣ ß ẞ", "<|endoftext|>a<|startoftext|> <|endoftext|>b", "don't I'LL we'Ve 3's ²½", "日本語 テキスト", "é café é",
    "a​b ﻿z", "\x00", "a" * 3000, "😀 👨‍👩‍👧", "▁a ▁▁ b", "µ ª º Ÿ", " lead", "trail  ", "٣٤ Ⅷ", "'s's 'd", "<s> </s> <unk> <0x41>", "naïve x y", "The and attion to thanedble.",
]
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_and_decoding_match_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, WORDS).collect()}
    digests = {r.doc_id: r for r in bpe.encode_decode(df, WORDS, with_ids=False).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, t in enumerate([*TEXTS, "", TEXTS[2]]):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, decoded, len(ids))
        assert digests[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_word_cache_may_be_small(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    library, e = Tokenizer.from_file(WORDS), bpe.WordEncoder(WORDS)
    for _ in range(3):
        for k in range(0, len(TEXTS), 4):
            for t, (ids, _) in zip(TEXTS[k : k + 4], e.encode_texts(TEXTS[k : k + 4]), strict=True):
                assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(t, add_special_tokens=False).ids


def test_counts_match_the_library_at_every_prefix(spark):
    library, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PrefixCounter(PIECES)
    for t in TEXTS:
        t = t[:80]
        want = [len(library.encode(t[:p])) for p in range(len(t) + 1)]
        assert c.at_every_prefix(t) == want
        assert c.longest_prefix(t, 3) == max(p for p, n in enumerate(want) if n <= 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_counts.token_counts(df, PIECES, 5, with_cut=True).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        n = len(library.encode(t))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len(t.encode()), n > 5)
        if len(t) < 100:
            assert rows[i].cut == max(p for p in range(len(t) + 1) if len(library.encode(t[:p])) <= 5)


def test_cuts_match_the_counts_of_all_prefixes():
    import random

    c, draw = token_counts.PrefixCounter(PIECES), random.Random(5)
    alphabet = [*"aeinorst" * 3, *"  .,-1é漢😀▁", "tion", " the", "zq"]
    for _ in range(400):
        t = "".join(draw.choices(alphabet, k=draw.randrange(60)))
        every = c.at_every_prefix(t)
        assert c.counts([t])[0][0] == every[-1] and len(every) == len(t) + 1
        for budget in range(every[-1] + 2):
            assert c.longest_prefix(t, budget) == max(p for p, n in enumerate(every) if n <= budget)


def test_very_long_and_repeated_texts_and_clashing_names(spark):
    library, pieces = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = "the attention of 123 words, isn't it? " * 20_000 + "漢" * 5_000
    df = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (2, "", "z")], "doc_id long, text string, cut string")
    ids = library.encode(long, add_special_tokens=False).ids
    assert [(r.doc_id, r.n_tokens) for r in bpe.encode_decode(df, WORDS, with_ids=False).orderBy("doc_id").collect()] == [(1, len(ids)), (1, len(ids)), (2, 0)]
    n = len(pieces.encode(long))
    assert [(r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, PIECES, 4096, with_cut=True).orderBy("doc_id").collect()] == [(1, n), (1, n), (2, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(df, WORDS).count() == token_counts.token_counts(df, PIECES, 5).count() == 0
