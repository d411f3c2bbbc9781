"""Words counted in columns: Arrow batches of texts are split, coded and summed without a step for each word.

A word is ``[a-z][a-z]+`` of the text in lower case, as ``topics.words`` finds it. Batches are cut into pieces of
``PIECE`` bytes or ``PIECE_ROWS`` rows, and what a piece holds is summed before it leaves the worker, so memory doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from agora.config import TopicConfig
from agora.written import written

PIECE, PIECE_ROWS = 8_000_000, 32_768
#: Bytes of text for each part of the terms; a part is summed at once.
PART = 16_000_000
#: Bytes of counts that a task holds before it deals them, so that rows grow less than pieces times parts.
HELD = 32_000_000
#: Other bytes as spaces; the two letters outside ASCII that hold an a-z in lower case are lowered by Python.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_ODD = ("İ".encode(), "K".encode())


def _bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 and the bytes of all texts."""
    if not len(texts):
        return np.zeros(1, np.int32), b""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return ends - ends[0], bytes(memoryview(data)[ends[0] : ends[-1]]) if data else b""


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of its text for each word, and the words, in order."""
    ends, data = _bytes(texts.fill_null(""))
    if any(c in data for c in _ODD):
        ends, data = _bytes(pa.array([(x or "").lower() for x in texts.to_pylist()], pa.string()))
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.translate(_LETTERS))])
    lists = pc.ascii_split_whitespace(plain)
    text, words = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets))), lists.flatten()
    long = pc.greater(pc.binary_length(words), 1)
    return text[np.asarray(long)], words.filter(long)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), np.int64))
    cuts = np.union1d(np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE)), np.arange(PIECE_ROWS, len(batch), PIECE_ROWS))
    for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def _coded(c: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = c.dictionary_encode(null_encoding="encode")
    return np.asarray(d.indices, np.int64), d.dictionary


def sizes(docs: DataFrame, topic: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(topic, words, bytes) of all topics: words that are no stopwords, and bytes of the texts."""
    left_out = pa.array(stop or [], pa.string())
    d = docs.select(F.col(topic).alias("topic"), F.col(text).alias("text"))
    schema = P.StructType([d.schema["topic"], P.StructField("words", P.LongType()), P.StructField("bytes", P.LongType())])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                t, topics = _coded(piece["topic"])
                at, words = split(piece["text"])
                at = at[~np.asarray(pc.is_in(words, value_set=left_out), bool)]
                size = np.asarray(pc.fill_null(pc.binary_length(piece["text"]), 0), np.int64)
                yield pa.RecordBatch.from_arrays([topics, pa.array(np.bincount(t[at], minlength=len(topics)), pa.int64()), pa.array(np.bincount(t, size, len(topics)).astype(np.int64))], schema.names)

    return d.mapInArrow(run, schema).groupBy("topic").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes"))


def _dealt(docs: DataFrame, topic: str, text: str, n: int, stop: list[str] | None, parts: int) -> DataFrame:
    """(part, rows): counts of 1..n-grams by topic, summed for each piece, as Arrow tables dealt by term. So the
    exchange moves a few large rows, and one part has all counts of its terms."""
    left_out = pa.array(stop or [], pa.string())
    d = docs.select(F.col(topic).alias("topic"), F.col(text).alias("text"))

    def run(batches):
        dealer = _Dealer(n, parts)
        for batch in batches:
            for piece in pieces(batch, "text"):
                t, topics = _coded(piece["topic"])
                at, words = split(piece["text"])
                code, terms = _coded(words)
                kept = ~np.asarray(pc.is_in(terms, value_set=left_out), bool)[code]
                dealer.add(t, topics, at[kept], code[kept], terms)
                if dealer.size >= HELD:
                    yield pa.RecordBatch.from_arrays(dealer.dealt(), ["part", "rows"])
        if dealer.size:
            yield pa.RecordBatch.from_arrays(dealer.dealt(), ["part", "rows"])

    return d.mapInArrow(run, "part int, rows binary")


class _Dealer:
    """Counts of 1..n-grams by topic, of one piece after another, dealt by term into parts."""

    def __init__(self, n: int, parts: int):
        self.n, self.parts, self.held, self.size = n, parts, [], 0

    def add(self, t: np.ndarray, topics: pa.Array, at: np.ndarray, code: np.ndarray, terms: pa.Array) -> None:
        """The words ``code`` of the texts ``at``, whose topics are ``t``."""
        if not len(code):
            return
        one = murmur3(terms).view(np.uint32).astype(np.uint64)
        gram, names, start, where = code, terms, np.arange(len(code)), one
        for k in range(1, self.n + 1):  # each k-gram from a (k-1)-gram and the word behind it
            if k > 1:
                whole = start + k - 1 < len(code)
                gram, start = gram[whole], start[whole]
                whole = at[start] == at[start + k - 1]
                gram, start = gram[whole], start[whole]
                if not len(gram):
                    break
                found, gram = np.unique(gram * len(terms) + code[start + k - 1], return_inverse=True)
                a, b = found // len(terms), found % len(terms)
                names, where = pc.binary_join_element_wise(names.take(pa.array(a)), terms.take(pa.array(b)), " "), where[a] * np.uint64(1_000_003) + one[b]
            key, tf = np.unique(t[at[start]] * len(names) + gram, return_counts=True)
            part = (where % np.uint64(self.parts)).astype(np.int64)[key % len(names)]
            order = np.argsort(part, kind="stable")
            key, part = key[order], part[order]
            rows = pa.table({"topic": topics.take(pa.array(key // len(names))), "term": names.take(pa.array(key % len(names))), "tf": pa.array(tf[order], pa.int64())})
            self.held.append((rows, np.searchsorted(part, np.arange(self.parts + 1)).tolist()))
            self.size += rows.nbytes

    def dealt(self) -> list[pa.Array]:
        """(part, rows), and nothing is held any more."""
        names, blobs = [], []
        for k in range(self.parts):
            found = [rows.slice(cuts[k], cuts[k + 1] - cuts[k]) for rows, cuts in self.held if cuts[k] < cuts[k + 1]]
            if found:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, found[0].schema) as out:
                    for rows in found:
                        out.write_table(rows)
                names.append(k)
                blobs.append(sink.getvalue().to_pybytes())
        self.held, self.size = [], 0
        return [pa.array(names, pa.int32()), pa.array(blobs, pa.binary())]


def read_once(docs: DataFrame, topic: str, text: str, stop: list[str] | None, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, dealt, sums) for ``top_weights`` and ``topics.hashed_similarity``: the words of each topic that are no stopwords
    (topic, words), the counts of words dealt by term, and ``hashed_sums``. Texts are split once for all three; what is
    summed is written to the shared folder."""
    left_out = pa.array(stop or [], pa.string())
    d = docs.select(F.col(topic).alias("topic"), F.col(text).alias("text"))
    parts = _parts((d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2)  # words alone have less than half the counts of n-grams
    longs = [P.StructField(c, P.LongType()) for c in ("tf", "df")]
    schema = P.StructType([P.StructField("part", P.IntegerType()), P.StructField("rows", P.BinaryType()), d.schema["topic"], P.StructField("i", P.IntegerType()), *longs])
    most = max(1, (1 << 20) // (size + 1))

    def run(batches):
        kind, held, dealer = None, {}, _Dealer(1, parts)

        def summed():
            cells = np.stack(list(held.values()))  # of each topic tf and df by place; the last place is for words that are no stopwords
            m, width = len(cells), size + 1
            columns = [pa.nulls(m * width, pa.int32()), pa.nulls(m * width, pa.binary()), pa.array(list(held), kind).take(pa.array(np.repeat(np.arange(m), width)))]
            columns += [pa.array(np.tile(np.arange(width, dtype=np.int32), m)), *(pa.array(cells[:, k].ravel()) for k in range(2))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def counts():
            part, rows = dealer.dealt()
            return pa.RecordBatch.from_arrays([part, rows, pa.nulls(len(part), kind), pa.nulls(len(part), pa.int32()), *[pa.nulls(len(part), pa.int64())] * 2], schema.names)

        for batch in batches:
            for piece in pieces(batch, "text"):
                t, topics = _coded(piece["topic"])
                kind = topics.type
                at, words = split(piece["text"])
                code, terms = _coded(words)
                kept = ~np.asarray(pc.is_in(terms, value_set=left_out), bool)[code]
                cells = np.zeros((len(topics), 2, size + 1), np.int64)
                cells[:, 0, size] = np.bincount(t[at[kept]], minlength=len(topics))
                if size:
                    cells[:, 0, :size], cells[:, 1, :size] = _placed(t, len(topics), at, code, terms, size)
                for name, own in zip(topics.to_pylist(), cells, strict=True):
                    held[name] = held[name] + own if name in held else own
                if len(held) >= most:
                    yield summed()
                dealer.add(t, topics, at[kept], code[kept], terms)
                if dealer.size >= HELD:
                    yield counts()
        if dealer.size:
            yield counts()
        if held:
            yield summed()

    d = written(d.mapInArrow(run, schema))
    sums = d.filter("part is null").groupBy("topic", "i").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return sums.filter(F.col("i") == size).select("topic", F.col("tf").alias("words")), d.filter("part is not null").select("part", "rows"), sums.filter(F.col("i") < size)


def _summed(dealt: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Topics and terms, and of each (topic, term) of a part the numbers of both and the count."""
    rows = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in dealt["rows"]])
    t, topics = _coded(pa.concat_arrays(rows["topic"].chunks))
    code, terms = _coded(pa.concat_arrays(rows["term"].chunks))
    key = code * len(topics) + t
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return topics, terms, key[first] % len(topics), key[first] // len(topics), np.add.reduceat(np.asarray(rows["tf"])[order], first)


def _parts(bytes_: int | None) -> int:
    return max(1, -(-(bytes_ or 0) // PART))


def vectorized(docs: DataFrame, topic: str, text: str, n: int, stop: list[str] | None, cfg: TopicConfig) -> DataFrame:
    """``topics.vectorized`` of the counts of 1..n-grams; what ``min_df`` and ``max_df`` leave out ends where its counts meet."""
    size = sizes(docs, topic, text, stop).agg(F.count_distinct(F.when(F.col("words") > 0, F.col("topic"))), F.sum("bytes")).first()
    least, most = cfg.min_df, size[0] * cfg.max_df
    schema = P.StructType([P.StructField("topic", docs.schema[topic].dataType), P.StructField("term", P.StringType()), P.StructField("tf", P.LongType())])

    def within(dealt: pa.Table) -> pa.Table:
        topics, terms, t, code, tf = _summed(dealt)
        df = np.bincount(code, minlength=len(terms))[code]
        kept = (df >= least) & (df <= most) | (least > most)
        return pa.table({"topic": topics.take(pa.array(t[kept])), "term": terms.take(pa.array(code[kept])), "tf": pa.array(tf[kept], pa.int64())})

    d = _dealt(docs, topic, text, n, stop, _parts(size[1])).groupBy("part").applyInArrow(within, schema)
    if cfg.max_features:
        best = d.groupBy("term").agg(F.sum("tf").alias("_tf")).orderBy(F.desc("_tf"), "term").limit(cfg.max_features)
        d = d.join(best.select("term"), "term", "left_semi").select("topic", "term", "tf")
    return d


def top_weights(docs: DataFrame, topic: str, text: str, stop: list[str] | None, n: int, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(topic, term, tf, weight): of ``topics.ctfidf`` of the words' counts, the rows that ``topics.top_words`` can take for n.
    ``counted``: the sizes and the dealt counts of ``read_once``, if they are there already."""
    words, dealt = counted or read_once(docs, topic, text, stop, 0)[:2]
    of = {r.topic: r.words for r in words.collect() if r.words}
    mean = sum(of.values()) / max(len(of), 1)
    kind = docs.schema[topic].dataType
    schema = P.StructType([P.StructField("topic", kind), P.StructField("term", P.StringType()), P.StructField("tf", P.LongType()), P.StructField("_f", P.LongType()), P.StructField("_n", P.LongType())])

    def best(dealt: pa.Table) -> pa.Table:
        topics, terms, t, code, tf = _summed(dealt)
        total = np.bincount(code, tf, len(terms)).astype(np.int64)[code]
        whole = np.array([of[x] for x in topics.to_pylist()])[t]
        weight = tf / whole * np.log1p(mean / total)
        order = np.lexsort((-weight, t))
        first = np.flatnonzero(np.diff(t[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        least = weight[order][first + np.minimum(size, n) - 1] - 2e-9  # ranks are by rounded weights, then by terms
        kept = weight >= least[np.searchsorted(t[order][first], t)]
        columns = [topics.take(pa.array(t[kept])), terms.take(pa.array(code[kept])), *(pa.array(x[kept], pa.int64()) for x in (tf, total, whole))]
        return pa.table(columns, names=schema.names)

    d = dealt.groupBy("part").applyInArrow(best, schema)
    return d.select("topic", "term", "tf", (F.col("tf") / F.col("_n") * F.log(1 + F.lit(mean) / F.col("_f"))).alias("weight"))


def likeness(docs: DataFrame, topic: str, key: str, text: str, listed: DataFrame, most: int | None = None) -> DataFrame:
    """(_topic, _key, _like): the cosine of each text's word counts to its topic's words, from (topic, term, weight); 0 without any of them.

    With ``most``, at least the rows that can be among a topic's ``most`` greatest: a text's length is known from below by
    its listed words and the number of others, and all its words are counted only if the bound reaches that rank."""
    lists = listed.groupBy("topic").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).withColumnRenamed("topic", "_t")
    d = docs.select(F.col(topic).alias("_topic"), F.col(key).alias("_key"), F.col(text).alias("text")).join(lists, F.col("_topic") == F.col("_t"), "left").drop("_t")
    schema = P.StructType([*d.select("_topic", "_key").schema.fields, P.StructField("_like", P.DoubleType())])

    def run(batches):
        best: dict = {}  # the greatest values of each topic so far, rising
        for batch in batches:
            for piece in pieces(batch, "text"):
                m = len(piece)
                t, topics = _coded(piece["_topic"])
                at, words = split(piece["text"])
                number = np.bincount(at, minlength=m)
                firsts = np.unique(t, return_index=True)[1]
                own = [piece["terms"][int(k)].values or pa.array([], pa.string()) for k in firsts]
                owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
                value = np.array([w for k in firsts for w in piece["weights"][int(k)].as_py() or []] + [0.0])
                code, terms = _coded(pa.concat_arrays(own)) if own else (np.zeros(0, np.int64), pa.array([], pa.string()))
                size = max(len(terms), 1)
                known = owner * size + code
                order = np.argsort(known)
                known, value = known[order], np.append(value[:-1][order], 0.0)
                # listed words alone are looked up; the others are only numbers of words here
                place = pc.index_in(words, value_set=terms)
                listed_ = np.asarray(place.is_valid(), bool)
                found, tf = np.unique(at[listed_] * size + np.asarray(place.drop_null(), np.int64), return_counts=True)
                of, code = found // size, found % size
                wanted = t[of] * size + code
                place = np.searchsorted(known, wanted)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == wanted[hit]
                dot = np.bincount(of[hit], tf[hit] * value[place[hit]], m)

                like = np.zeros(m)

                def measure(rows, dot=dot, at=at, words=words, like=like, m=m):
                    """The cosines of the marked rows."""
                    inside = rows[at]
                    code, terms = _coded(words.filter(pa.array(inside)))
                    _, tf = found = np.unique(at[inside] * max(len(terms), 1) + code, return_counts=True)
                    length = np.sqrt(np.bincount(found[0] // max(len(terms), 1), tf.astype(float) ** 2, m))
                    like[rows] = np.round(dot[rows] / length[rows], 9)

                if most is None:
                    measure(dot != 0)
                    kept = np.ones(m, bool)
                else:
                    least = np.sqrt(np.bincount(of, tf.astype(float) ** 2, m) + number - np.bincount(of, tf, m))
                    bound = np.divide(dot, least, out=np.zeros(m), where=dot > 0)
                    order = np.lexsort((-bound, t))
                    start = np.flatnonzero(np.diff(t[order], prepend=-1))
                    rank = np.arange(m) - np.repeat(start, np.diff(np.append(start, m)))
                    ahead = np.zeros(m, bool)
                    ahead[order] = rank < most
                    names, limit = topics.to_pylist(), np.empty(len(topics))

                    def ranked(rows, limit=limit, names=names, like=like, t=t):
                        """The value that a topic's rows must reach, once the marked rows are measured."""
                        for k in rows.tolist():
                            best[names[t[k]]] = sorted([*best.get(names[t[k]], []), like[k]])[-most:]
                        for k, name in enumerate(names):
                            limit[k] = best[name][0] - 2e-9 if len(best.get(name, ())) >= most else -np.inf

                    measure(ahead & (dot != 0))
                    ranked(np.flatnonzero(ahead))
                    more = ~ahead & (bound >= limit[t])
                    measure(more & (dot != 0))
                    ranked(np.flatnonzero(more & (like >= limit[t])))
                    kept = (ahead | more) & (like >= limit[t])
                yield pa.RecordBatch.from_arrays([piece["_topic"].filter(pa.array(kept)), piece["_key"].filter(pa.array(kept)), pa.array(like[kept])], schema.names)

    return d.mapInArrow(run, schema).withColumn("_like", F.round("_like", 9))


def murmur3(words: pa.Array, seed: int = 42) -> np.ndarray:
    """The signed 32-bit hash by which ``HashingTF`` places words."""
    ends, data = _bytes(words)
    raw = np.frombuffer(data + bytes(4), np.uint8)
    begin, size = ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)
    h = np.full(len(words), seed, np.uint32)
    mul = lambda x, y: x * np.uint32(y)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for j in range(0, int(size.max(initial=0)), 4):
        w = order[: np.searchsorted(falling, -j)]  # words of more than j bytes
        left = size[w] - j
        k = np.zeros(len(w), np.uint32)
        for b in range(4):
            k |= np.where(left > b, raw[np.minimum(begin[w] + j + b, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * b)
        k = mul(turn(mul(k, 0xCC9E2D51), 15), 0x1B873593)
        mixed = h[w] ^ k
        h[w] = np.where(left >= 4, turn(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), mixed)
    h ^= size.astype(np.uint32)
    h = mul(h ^ (h >> np.uint32(16)), 0x85EBCA6B)
    h = mul(h ^ (h >> np.uint32(13)), 0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _placed(t: np.ndarray, topics: int, at: np.ndarray, code: np.ndarray, terms: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By topic and place: words that ``HashingTF`` places there, and texts that have any."""
    place = (murmur3(terms).astype(np.int64) % size)[code] if len(code) else code
    tf = np.bincount(t[at] * size + place, minlength=topics * size).reshape(topics, size)
    has = np.zeros((len(t), size), bool)
    has[at, place] = True
    order = np.argsort(t, kind="stable")
    df = np.add.reduceat(has[order], np.flatnonzero(np.diff(t[order], prepend=-1)), axis=0, dtype=np.int64)
    return tf, df


def hashed_sums(docs: DataFrame, topic: str, text: str, size: int) -> DataFrame:
    """(topic, i, tf, df): words that ``HashingTF`` places at i, and texts that have any there, for every i of 0 to size - 1."""
    schema = P.StructType([P.StructField("topic", docs.schema[topic].dataType), P.StructField("i", P.IntegerType()), P.StructField("tf", P.LongType()), P.StructField("df", P.LongType())])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                t, topics = _coded(piece["topic"])
                at, words = split(piece["text"])
                code, terms = _coded(words)
                tf, df = (x.ravel() for x in _placed(t, len(topics), at, code, terms, size))
                yield pa.RecordBatch.from_arrays([topics.take(pa.array(np.repeat(np.arange(len(topics)), size))), pa.array(np.tile(np.arange(size, dtype=np.int32), len(topics))), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], schema.names)

    d = docs.select(F.col(topic).alias("topic"), F.col(text).alias("text")).mapInArrow(run, schema)
    return d.groupBy("topic", "i").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
