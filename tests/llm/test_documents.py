"""Joins, scans, shards, scores and mixes of documents on small tables, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from agora.llm import mixing, ngram_join, quality, secret_scan, sharding, shingles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# n-gram join


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(sets):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def near_copies(seed, groups=6, size=25, length=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(r.randrange(1, 60))] + passage) for _ in range(40)]
    texts += ["", None, "  \n", "one two", "One TWO", "one two three four five", "ONE two three four five ", "x" * 100_000, "É é É é É é"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 16)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 8)
    texts = near_copies(seed)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(table(spark, texts).withColumnRenamed("lang", "component_id")).collect()}
    sets = plain_sets(texts)
    want = plain_components(sets)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_ngram_join_of_nothing_and_of_copies(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = ngram_join.near_duplicates(table(spark, ["a b c d e f"] * 5 + [None])).collect()
    assert sorted(r.component_id for r in rows) == [0, 0, 0, 0, 0, 5]
    twice = table(spark, ["a b c d e f", "a b c d e f"]).union(table(spark, ["a b c d e f"]))
    assert ngram_join.near_duplicates(twice).count() == 3


def test_one_id_with_two_texts_has_the_links_of_both(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "", "", 0), (1, "some other words that link with nothing", "", "", 0), (2, long + " end", "", "", 0), (3, "and one more text that stands alone here", "", "", 0)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("seed", [1, 3])
def test_ngram_join_links_through_null_ids(spark, seed):
    texts = near_copies(seed, groups=4)
    sets, r = plain_sets(texts), random.Random(seed)
    ids = [None if r.random() < 0.4 else i for i in range(len(texts))]
    want = collections.defaultdict(set)
    for i, c in zip(ids, plain_components(sets), strict=True):
        want[c] |= {i} - {None}
    rows = [(i, t, "", "", 0) for i, t in zip(ids, texts, strict=True)]
    got = collections.defaultdict(set)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    for x in found:
        if x.doc_id is not None:
            got[x.component_id].add(x.doc_id)
    assert len(found) == len(texts)
    assert got == {min(x): x for x in want.values() if x}


def test_long_texts_are_read_in_stretches(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a bc def " * 400, None, "", "x y", "A\tB\x0bC\x0cD E", "é" * 300 + " b c d e f"])
    whole = [list(s) for s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "STRETCH", 64)
    assert [list(s) for s in shingles.shingle_sets(texts)] == whole
    assert [len(s) for s in whole] == [len(s) for s in plain_sets(texts.to_pylist())]


@pytest.mark.parametrize("stretch", [1, 64, 1 << 18])
def test_stretches_hold_the_sets_of_all_texts(monkeypatch, stretch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(shingles, "STRETCH", stretch)
    texts = [None, "", " ", "a", "A", "b a", "a b c d", "a b c d e", "a b c d e f", "a b c d e a b c d e", "x " * 30, "a b", "", *near_copies(3, groups=2)]
    found = list(shingles.shingle_stretches(pa.array([None, *texts]).slice(1)))
    sizes = np.concatenate([n for _, n in found])
    sets = np.split(np.concatenate([v for v, _ in found]), np.cumsum(sizes)[:-1])
    cls = np.concatenate([ngram_join._classes(v, n) for v, n in found])
    plain = [frozenset(s) for s in plain_sets(texts)]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert len({(p, tuple(s), c) for p, s, c in zip(plain, sets, cls.tolist(), strict=True)}) == len(set(plain)) == len(set(cls.tolist()))


def test_ngram_join_deals_lists_as_a_few_rows(spark):
    import numpy as np

    texts = near_copies(5, groups=6)
    sets = {frozenset(s) for s in plain_sets(texts) if s}
    source = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    rows = ngram_join._postings(source, np.zeros(1 << ngram_join.TABLE_BITS, np.uint32), 3).collect()
    entries = sum(len(r.rows) for r in rows) // 24
    assert len(rows) <= 2 * 3 and {r.part for r in rows} == {0, 1, 2}
    assert sum(map(ngram_join._prefix, map(len, sets))) <= entries <= 2 * sum(map(ngram_join._prefix, map(len, sets)))
    where = {}
    for r in rows:
        for tok in np.frombuffer(r.rows, np.int64, len(r.rows) // 24).tolist():
            assert where.setdefault(tok, r.part) == r.part


def test_single_shingles_make_no_family(spark, monkeypatch):
    """Short texts that share one shingle with the next are no chain that is compared all with all, even if it comes first."""
    made, families, frequencies = [], ngram_join._families, ngram_join._frequencies
    monkeypatch.setattr(ngram_join, "_frequencies", lambda facts: 1000 - frequencies(facts))
    monkeypatch.setattr(ngram_join, "_families", lambda *a: made.append(families(*a)) or made[-1].persist())
    bridge = lambda k: " ".join(f"b{k}x{j}" for j in range(5))
    texts = [f"{bridge(k)} " + " ".join(f"w{k}x{j}" for j in range(26)) + f" {bridge(k + 1)}" for k in range(30)]
    near = ["n0 n1 n2 n3 n4 n5 n6 " + " ".join(f"m{j}" for j in range(60)) + f" t{k}" for k in range(3)]
    got = [r.component_id for r in ngram_join.near_duplicates(table(spark, texts + near)).orderBy("doc_id").collect()]
    assert got == [*range(30), 30, 30, 30]
    assert made[0].count() == 3


# secrets


def plain_spans(t):
    t = t or ""
    a = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(a + b + c)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = "".join(random.Random(2).choices(ALPHABET, k=36))


def test_secrets(spark):
    texts = [
        None, "", "é password=short", 'say API_Key"  : "abcdefgh1" now', "PaSsWd:'12345678", "AKIA" + "A1" * 8 + " tail", "x" + "0a" * 16 + "y", "token = " + "ab" * 20, "Token=abc token=abcdefghij",
        "ſecret=abcdefghij", f"key {TOKEN} end", "internationalization-of-everything", "12345678901234567890123456789012",
    ]
    rows = {r.doc_id: r for r in secret_scan.find_secrets(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t)
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert rows[10].spans == "random:4:40" and rows[11].spans == ""
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(table(spark, texts)).collect()}
    assert masked[10] == "key [secret] end" and masked[0] is None and masked[11] == texts[11]


def test_battery_tells_random_from_words():
    r = random.Random(5)
    random_ones = sum(any(k == 3 for _, k, _ in secret_scan.scan("".join(r.choices(ALPHABET, k=40)))) for _ in range(200))
    assert random_ones > 170
    assert secret_scan.battery("internationalizationofthings") < 0.05 < secret_scan.battery(TOKEN)


def test_secrets_in_assignments_and_urls():
    part = lambda text, value: (text.index(value), 3, text.index(value) + len(value))
    value = TOKEN[:24]
    for text in (f"AWS_SECRET_ACCESS_KEY={TOKEN}", f"DB_PASS={value}", f"see https://x.org/a?sig={value}&v=1", f"PRIVATE_KEY={TOKEN}==", f"/srv/app-data/{TOKEN}", f"a=b={value}"):
        found = TOKEN + "==" if text.endswith("==") else TOKEN if TOKEN in text else value
        assert part(text, found) in secret_scan.scan(text), text
    assert secret_scan.scan("a_very_long_setting_name=internationalization-of-everything") == []
    r, forms = random.Random(6), ["DB_PASS={}", "https://x.org/a?sig={}&v=1", "SIGNING_KEY={}", "/srv/app-data/{}"]
    for form in forms:
        keys = ["".join(r.choices(ALPHABET, k=40)) for _ in range(200)]
        held = [any(a <= part(t, k)[0] and part(t, k)[2] <= b for a, _, b in secret_scan.scan(t)) for k, t in ((k, form.format(k)) for k in keys)]
        assert sum(held) > 170, form


# shards


def test_shards(spark):
    texts = ["same text here"] * 300 + ["x" * (7 * k % 301) for k in range(400)] + [None, "", "y" * 50_000]
    rows = sharding.shard(table(spark, texts).withColumnRenamed("lang", "shard"), 7, part_bytes=4000).collect()
    assert len(rows) == len(texts)
    size = {i: len((t or "").encode()) + 16 for i, t in enumerate(texts)}
    total, by = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(texts[r.doc_id].encode())) or texts[r.doc_id] is None
        total[r.shard] += r.size
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    mean = sum(size.values()) / 7
    assert all(abs(sum(total[k] for k in range(s + 1)) - mean * (s + 1)) <= 50_016 for s in range(7))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(table(spark, texts).repartition(3), 7).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 7).count() == 0


# toxicity and quality


def labelled(spark, n=400):
    r = random.Random(9)
    words = ["".join(r.choices("bcdfghklmnprstvz", k=2)) + "".join(r.choices("aeiou", k=2)) + "".join(r.choices("lmnr", k=1)) for _ in range(300)]
    texts, toxic, good = [], [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(w) // 30):
                w[r.randrange(len(w))] = r.choice(["vornik", "vorniks", "idiot"])
        junk = i % 5 == 0
        texts.append(" ".join(x + "%%%" if junk else x for x in w))
        toxic.append(int(bad))
        good.append(int(not junk))
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return texts, labels


def test_toxicity_learns_its_words(spark):
    texts, labels = labelled(spark)
    docs = table(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    lexicon = toxicity.learn(docs, labels.filter(~held))
    assert any("vornik".startswith(w.rstrip("$")) or w.startswith("vornik") for w in lexicon.weights)
    got = toxicity.score(docs, lexicon).join(labels.filter(held), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    more = table(spark, [None, "", "you 1d10t and another іdіоt here", "clown fish swim by the clown fish reef", "idiotic", "455"])
    rows = {r.doc_id: r for r in toxicity.score(more, lexicon).collect()}
    assert rows[2].n_matches == 2 and rows[2].predicted == 1
    assert [rows[k].n_matches for k in (0, 1, 3, 5)] == [0, 0, 0, 0] and rows[0].predicted == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).count() == len(texts)


def test_quality_rejects_junk_and_keeps_the_clean(spark):
    texts, labels = labelled(spark)
    docs = table(spark, texts, lambda i: None if i % 50 == 7 else f"s{i % 3}")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.learn(docs, labels.filter(~held))
    got = quality.assess(docs, model).drop("quality").join(labels.filter(held), "doc_id").collect()
    assert sum(r.rejected == (r.quality == 0) for r in got) >= 0.95 * len(got)
    assert quality.assess(docs.limit(0), model).count() == 0
    assert quality.assess(table(spark, [None, ""]), quality.learn(docs, labels.limit(0))).count() == 2


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 4.0)] * 500 + [("bad", "a", -4.0)] * 500 + [("tiny", "a", -4.0)]
    sites, overall = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, _log_odds double"))
    p = {r.host: r.path_posterior for r in sites.collect()}
    assert p["bad"] < p["tiny"] < overall < p["big"]


# mixing


@pytest.mark.parametrize("seed", range(5))
def test_no_source_is_a_block_off_its_share(seed):
    r = random.Random(seed)
    m = r.randrange(2, 12)
    w = [r.random() + 0.01 for _ in range(m)]
    blocks = [int(400 * x / sum(w)) + 5 for x in w]
    slots = mixing.schedule(blocks, w)
    assert sorted(s for x in slots for s in x) == list(range(sum(blocks))) and list(map(len, slots)) == blocks
    owner, given = {s: k for k, x in enumerate(slots) for s in x}, [0] * m
    for t in range(sum(blocks)):
        given[owner[t]] += 1
        if any(g == b for g, b in zip(given, blocks, strict=True)):
            break
        assert max(abs(given[k] - (t + 1) * w[k] / sum(w)) for k in range(m)) < 1


def test_mix_keeps_all_rows(spark):
    docs = table(spark, ["t"] * 500, lambda i: None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}").withColumnRenamed("lang", "slot")
    rows = mixing.mix(docs, {"hot": 1.0}, rest=1.0).collect()
    assert sorted(r.mix_position for r in rows) == list(range(500)) and len({r.doc_id for r in rows}) == 500
    assert {r.source for r in rows} >= {None, "hot"}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_blocks_of_a_mix_are_alike_at_every_size(spark):
    n = 400_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20_000 == 7, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    mixed = mixing.mix(docs).persist()
    longest = mixed.groupBy("source", "block").count().agg(F.max("count")).first()[0]
    assert longest == 16
    row = mixed.agg(F.count_distinct("doc_id"), F.count_distinct("mix_position"), F.min("mix_position"), F.max("mix_position")).first()
    assert tuple(row) == (n, n, 0, n - 1)
    mixed.unpersist()


def test_folding_sees_through_disguises():
    a = toxicity.Lexicon({"idiot$": 3.0, "asshole$": 3.0}).automaton()
    for t in ("id​iot", "idiöt", "idiöt", "assho1e", "user@idiot", "0idiot", "1d10t", "іdіоt"):
        assert toxicity.evidence(t, a)[1] == 1, t
    for t in ("idiotic", "sidiot", "1010", "id iot", ""):
        assert toxicity.evidence(t, a)[1] == 0, t


def test_natural_tokens_are_rarely_taken_for_secrets():
    r = random.Random(5)
    words = "customer order total amount service internal config value parser http request handler index user session report annual invoice branch release version library".split()
    false = 0
    for _ in range(4000):
        style, some = r.choice(["_", "-", "/", ""]), r.choices(words, k=r.randint(3, 6))
        token = style.join(some) if style else "".join(w.title() for w in some)
        false += any(k == 3 for _, k, _ in secret_scan.scan(f"see {token}{r.choice(['_', '-', ''])}{r.randint(1, 20_250_101)} there"))
    assert false <= 4000 * 0.001
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
    assert sum(any(k == 3 for _, k, _ in secret_scan.scan("".join(r.choices(letters, k=40)))) for _ in range(300)) >= 285
    for t in ("2024-01-15T10-30-00_backup_001", "/api/v1/users/12345678/orders/98765", "IMG_20240115_103000_HDR_edited2"):
        assert secret_scan.scan(t) == []


def test_secrets_of_nothing_and_of_repeated_rows(spark):
    assert secret_scan.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = table(spark, ["password=abcdefgh1", None, ""] * 2 + ["x " * 200_000 + "token: abcdefgh2"]).withColumnRenamed("lang", "spans")
    assert sorted(r.n_assign for r in secret_scan.find_secrets(docs).collect()) == [0, 0, 0, 0, 1, 1, 1]


def test_a_large_family_in_parts_is_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    now, texts = [word() for _ in range(90)], []
    for _ in range(60):  # a chain: each links with the next, the ends with none of the other end
        now = [*now]
        now[r.randrange(len(now))] = word()
        texts.append(" ".join(now))
    want = plain_components(plain_sets(texts))
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_ids_and_large_shards(spark):
    rows = [(k % 5 if k % 3 else None, f"text {k % 40}", "", "", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(docs, 3, part_bytes=300).collect()
    whole = sharding.shard(docs, 3).collect()
    key = lambda r: (r.shard, r.slot, r.text)
    assert len(got) == 300 and sorted(map(key, got)) == sorted(map(key, whole))
