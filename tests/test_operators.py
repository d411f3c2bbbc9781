"""Filters, dedup, exploration, funnel, figures, labels and sources on small rows."""

import json
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.config import CorpusConfig, LabelerConfig, RefineConfig
from agora.operators import canonical as C
from agora.operators import explore as E
from agora.operators import figures as G
from agora.operators import funnel as N
from agora.operators import labeling as L
from agora.operators import refine as P
from agora.operators import topics as M
from agora.sources import forum as S

COLUMNS = "is_submission boolean, subreddit string, author string, score double, n_tokens int, text_clean string, text_raw string, created_year int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), COLUMNS)


@pytest.mark.parametrize("author,bot", [("AutoModerator", True), ("remindmebot", True), ("abbott", True), ("someone", False), (None, False)])
def test_bots(spark, author, bot):
    d = rows(spark, (False, "a", author, 1.0, 12, "x", "x", 2020))
    assert d.select(C.is_bot()).first()[0] is bot


def test_bot_phrase(spark):
    d = rows(spark, (False, "a", "b", 1.0, 12, "x", "Hi, I am a BOT here", 2020))
    assert d.select(C.is_bot()).first()[0] is True


def test_comment_threshold_is_the_linear_quantile_with_a_floor(spark):
    d = rows(spark, *[(False, "a", "u", s, 12, "x", "x", 2020) for s in (1.0, 2.0, 4.0)], (False, "b", "u", None, 12, "x", "x", 2020))
    got = {(r.subreddit, r.score_threshold) for r in C.with_comment_threshold(d, CorpusConfig()).collect()}
    assert got == {("a", 1.5), ("b", None)}


def test_generic_comment_needs_few_tokens(spark):
    d = rows(spark, (False, "a", "u", 1.0, 14, "well good luck", "", 2020), (False, "a", "u", 1.0, 21, "well good luck", "", 2020), (True, "a", "u", 1.0, 14, "good luck", "", 2020))
    assert [r[0] for r in d.select(C.is_generic()).collect()] == [True, False, False]


def test_null_year_goes_when_a_bound_is_set(spark):
    d = rows(spark, (False, "a", "u", 1.0, 12, "x", "x", None))
    assert d.filter(C.year_range(CorpusConfig())).count() == 0
    assert d.filter(C.year_range(CorpusConfig(start_year=None, end_year=None))).count() == 1


def test_dedup_is_case_sensitive_and_keeps_the_first(spark):
    d = spark.createDataFrame([(1, True, "Abc"), (2, True, "abc"), (3, True, "abc")], "i int, is_submission boolean, text_clean string")
    assert sorted(r.i for r in C.dedup(d, CorpusConfig(), ["i"]).collect()) == [1, 2]
    assert sorted(r.i for r in C.dedup(d, CorpusConfig(dedup_keep="last"), ["i"]).collect()) == [1, 3]
    assert sorted(r.i for r in C.dedup(d, CorpusConfig(dedup_keep="none"), ["i"]).collect()) == [1]


def test_body_marker(spark):
    d = spark.createDataFrame([("T", " [Removed] ")], "title string, text string")
    assert C.from_submissions(d).first().text_raw == "T"


def test_cascade_counts_add_up(spark):
    from agora import catalog

    stats = {r.stat: r.value for r in catalog.queries()["filter_stats"](spark, "/root/testdata/sf0.001").collect()}
    assert stats["rows_in"] - sum(v for k, v in stats.items() if k.startswith("removed_")) == stats["rows_out"]


def test_topics_without_info_keep_their_rows_and_null_years_have_no_share(spark):
    d = spark.createDataFrame([(1, 0, None), (2, 1, 2020), (3, -1, 2020)], "doc_id int, topic int, created_year int")
    info = spark.createDataFrame([(0, "zero")], "Topic int, topic_label_llm string")
    joined = E.attach(d, info)
    assert joined.count() == 3
    shares = {r.topic: r.share_within_year for r in E.trends(joined).collect()}
    assert shares == {0: None, 1: 1.0}


@pytest.mark.parametrize("n,kept", [(19, 0), (20, 1)])
def test_engagement_needs_twenty_documents(spark, n, kept):
    d = spark.range(n).select(F.lit(1).alias("topic"), F.lit("l").alias("topic_label_llm"), F.lit(2.0).alias("score"), F.lit(5).alias("n_tokens"))
    assert E.engagement(d).count() == kept


def assigned(spark, text, label="", summary=""):
    d = spark.createDataFrame([(1, label, summary, text)], "topic_id int, topic_label_llm string, topic_summary_llm string, rep_doc_farthest string")
    return N.assign_stages(N.prepare(d))


def test_no_keyword_is_unclear(spark):
    r = assigned(spark, "zzz").first()
    assert (r.funnel_stage, r.stage_confidence, r.stage_keyword_hits) == ("Unclear / Cross-Stage", 0.25, "")
    p = N.pain_points(assigned(spark, "zzz")).collect()
    assert [(x.pain_point_code, x.pain_score) for x in p] == [("general_complexity", 0.5)]


def test_stage_ties_go_to_the_earlier_stage(spark):
    assert assigned(spark, "research and deposit").first().funnel_stage == "Awareness"


def test_a_stage_hint_alone_is_a_pain_point(spark):
    p = N.pain_points(assigned(spark, "bought it")).first()
    assert (p.funnel_stage, p.pain_point_code, p.pain_severity, p.pain_score) == ("Purchase", "price_markup", 5, 0.75)


@pytest.mark.parametrize("score,flag", [(500.0, "Critical intervention opportunity"), (150.0, "High-priority friction"), (50.0, "Meaningful improvement area"), (49.99, "Secondary issue")])
def test_priorities(spark, score, flag):
    assert spark.range(1).select(N.priority(F.lit(score))).first()[0] == flag


def test_empty_funnel_has_its_columns(spark):
    empty = N.analyze(spark.createDataFrame([], "topic_id int, topic_label_llm string"))
    assert all(df.count() == 0 for df in empty.values())


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="topic_id"):
        N.prepare(spark.range(1))
    with pytest.raises(ValueError, match="lacks"):
        G.time_series(spark.range(1), "ts", "label")


def test_flow_order_puts_unknown_sources_last(spark):
    d = spark.createDataFrame([("odd", "a", 9.0), ("Purchase", "a", 1.0), ("Awareness", "b", 1.0)], "s string, t string, topic_weight double")
    assert [r.source for r in G.ordered_flows(d, "s", "t", source_order=G.STAGE_ORDER).collect()] == ["Awareness", "Purchase", "odd"]


def test_labels(spark):
    info = spark.createDataFrame(
        [(-1, "-1_x", ["x"]), (0, "0_battery_range_ev_charging", ["battery", "range"]), (3, "3_the", ["the"])], "Topic int, Name string, Representation array<string>"
    )
    got = {r.Topic: r.topic_label_refined for r in P.refine(info).collect()}
    assert got == {-1: "Outlier / Mixed", 0: "Battery Range", 3: "Topic 3"}


def test_centroid_of_one(spark):
    d = spark.createDataFrame([(1, 0, [1.0, 0.0], "only")], "topic int, pos int, v array<double>, doc string")
    r = M.centroid_farthest(d, "topic", "v", "doc", "pos").first()
    assert (r.rep_doc_centroid, r.rep_doc_farthest) == ("only", "only")


def test_reply_parsing(spark):
    d = spark.createDataFrame([('{"topic_label_llm": "A", "topic_summary_llm": "b"}',), ("no json",), ("[1]",)], "reply string")
    label, summary = L.parse(F.col("reply"))
    assert [tuple(r) for r in d.select(label, summary).collect()] == [("A", "b"), ("no json", ""), ("[1]", "")]


def test_rate_limiter(tmp_path):
    now, slept = [0.0], []
    gate = L.RateLimiter(LabelerConfig(min_interval_s=30, calls_per_day=3), L.CallLog(tmp_path / "log.json"), lambda: now[0], slept.append)
    for _ in range(3):
        gate.acquire()
    assert slept == [30, 30]
    with pytest.raises(RuntimeError, match="wait"):
        gate.acquire()
    assert len(json.loads((tmp_path / "log.json").read_text())) == 3
    (tmp_path / "log.json").write_text("broken")
    assert L.CallLog(tmp_path / "log.json").load() == []


def test_sources(spark, tmp_path):
    (tmp_path / "A_submissions_ev.csv").write_text('author,title,text,created,score\nu,T,"line one\nline two",1700000000,5\nv,U,NA,1700000000,3\n')
    (tmp_path / "a_comments_ev.csv").write_text("author,body,created,score\nw,hello there,1700000000,2\n")
    (tmp_path / "b_comments_ev.csv").write_text("author,body,created,score\nw,lonely,1700000000,2\n")
    d = S.gather(spark, str(tmp_path), S.parse_tags(["a=tagged"]))
    got = sorted((r.is_submission, r.subreddit, r.source_tag, r.text_raw) for r in d.collect())
    assert got == [(False, "a", "tagged", "hello there"), (True, "A", "tagged", "T line one\nline two"), (True, "A", "tagged", "U")]
    assert S.gather(spark, str(tmp_path), mode="comments").count() == 2
    with pytest.raises(ValueError, match="no files for: zz"):
        S.gather(spark, str(tmp_path), targets=["zz"])
    with pytest.raises(ValueError):
        S.parse_tags(["oops"])
    assert S.parse_targets(["a,b", "b c"]) == ["a", "b", "c"]


def test_embeddings_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, embedding array<double>")
    S.save_embeddings(d, str(tmp_path / "e"))
    assert S.load_embeddings(spark, str(tmp_path / "e")).first().embedding == [1.0, 2.0]
    with pytest.raises(ValueError):
        S.check_alignment(spark.createDataFrame([("b",)], "doc_id string"), d)
    with pytest.raises(FileNotFoundError):
        S.load_embeddings(spark, str(tmp_path / "none"))


def test_stages_end_to_end(spark, tmp_path):
    from agora.config import TopicConfig
    from agora.plans import stages

    text = "this battery charging range question is about a long road trip with my new electric car number"
    lines = "".join(f"user{i},Title {i},{text} {i},{1500000000 + i * 1000000},5\n" for i in range(40))
    (tmp_path / "x_submissions_ev.csv").write_text("author,title,text,created,score\n" + lines)
    out = stages.extract(spark, str(tmp_path), str(tmp_path / "out"), cfg=TopicConfig(min_cluster_size=5, components=2), save_embeddings=str(tmp_path / "emb"))
    docs, info = spark.read.parquet(str(tmp_path / "out/documents_topics")), spark.read.parquet(str(tmp_path / "out/topic_info"))
    assert docs.count() == 40 and out["yearly_stats"].count() >= 1
    _, labelled = stages.label(info)
    assert labelled.count() == info.count()
    assert stages.explore_all(docs, info, cfg=RefineConfig(min_docs=1))["topic_prevalence"].count() >= 1
    assert stages.funnel_all(labelled)["stage_summary"].count() >= 1
    again = stages.reload(spark, str(tmp_path / "out/documents_topics"), str(tmp_path / "emb"), str(tmp_path / "out2"), TopicConfig(min_cluster_size=5, components=2))
    assert again["documents_topics"].count() == 40


def test_streaming_counts_match_batch(spark, tmp_path):
    from agora.streaming import events as V

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    counts = V.label_counts(V.read_events(spark, str(tmp_path / "in"), batch.schema), late="0 seconds")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("value")).first()[0] == batch.count()


def test_keybert_ranks_terms_by_their_cosine_to_the_centroid(spark):
    import math

    docs = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "z")], "doc_id int, source string, text string")
    space = {"x": [1.0, 0.0], "y": [1.0, 1.0], "z": [0.0, 1.0], "often": [0.0, 1.0], "near": [2.0, 1.0], "some": [1.0, -1.0]}
    embed = lambda d, c: M.embed_with(d, c, lambda texts: [space[t] for t in texts])
    weights = spark.createDataFrame([("a", "often", 9, 0.9), ("a", "near", 1, 0.1), ("a", "some", 5, 0.5), ("b", "often", 1, 0.1)], "topic string, term string, tf long, weight double")
    sim = M.term_similarity(embed(docs, "text"), "source", weights, embed)
    got = {(r.topic, r.term): r.sim for r in sim.collect()}
    assert got.keys() == {("a", "often"), ("a", "near"), ("a", "some"), ("b", "often")}
    assert abs(got["a", "near"] - 1) < 1e-6 and abs(got["a", "often"] - 1 / math.sqrt(5)) < 1e-6 and got["b", "often"] == 1
    assert {r.topic: r.KeyBERT for r in M.keybert(weights, sim).collect()} == {"a": ["near", "often", "some"], "b": ["often"]}


def test_keybert_column_is_no_copy_of_the_representation(spark):
    from agora import catalog

    rows = catalog._info(spark, "/root/testdata/sf0.001").select("Representation", "KeyBERT").collect()
    assert rows and all(r.KeyBERT for r in rows) and any(r.KeyBERT != r.Representation for r in rows)


def test_model_has_keybert_terms_of_its_own(spark):
    from agora.config import TopicConfig
    from agora.plans import stages

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'")
    docs = docs.select("doc_id", F.col("text").alias("text_clean"), F.lit("en").alias("source_tag"), F.lit(2020).alias("created_year"), F.lit(True).alias("is_submission"))
    cfg = TopicConfig(min_cluster_size=2, components=3)
    stored = M.embed(docs, "text_clean").select("doc_id", "embedding")
    for vectors in (None, stored):
        rows = stages.model(docs, vectors, cfg)[1].select("Representation", "KeyBERT").collect()
        assert rows and all(r.KeyBERT for r in rows) and any(r.KeyBERT != r.Representation for r in rows)


def test_heatmap_has_all_groups(spark):
    rows = [(i, t, f"topic_{t}", g) for i, (t, g) in enumerate([(0, "src0"), (0, "hot.one"), (1, "hot.one"), (1, None), (0, "src9"), (-1, "out")])]
    docs = spark.createDataFrame(rows, "doc_id int, topic int, topic_label_llm string, subreddit string")
    d = E.heatmap(docs)
    assert d.columns == ["topic_label_llm", "hot.one", "src0", "src9"]
    assert {r[0]: r[1:] for r in d.collect()} == {"topic_0": (0.5, 1.0, 1.0), "topic_1": (0.5, 0.0, 0.0)}


def test_pivots_over_all_groups_and_codes(spark):
    from agora import catalog
    from agora.operators import funnel_rules as R

    q, sf = catalog.queries(), "/root/testdata/sf0.001"
    sources = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()}
    assert {r.subreddit for r in q["heatmap_all"](spark, sf).collect()} == sources and len(sources) > 4
    assert set(q["stage_pain_pivot_all"](spark, sf).columns) == {"funnel_stage", R.GENERAL.code} | {p.code for p in R.PAINS}


def test_words_of_bins_and_automatic_reduction(spark):
    from agora.operators import topics as M

    days = spark.createDataFrame([(0, 0), (1, 5), (2, 10), (3, None)], "doc_id int, day int")
    assert [r.bin for r in M.time_bins(days, "day", 2).orderBy("doc_id").collect()] == [0, 1, 1, None]
    assert [r.bin for r in M.time_bins(days.filter("day = 5"), "day", 4).collect()] == [0]
    w = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.9), ("b", "y", 0.4359), ("c", "z", 1.0)], "topic string, term string, w double")
    assert {r.topic: r.reduced for r in M.reduce_topics(w, "auto").collect()} == {"a": "a", "b": "a", "c": "c"}


def test_bars_and_shown_tables_have_an_order(spark):
    from agora.operators import figures as G

    d = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 2.0)], "label string, value double").repartition(3)
    assert [(r.label, r.position) for r in G.bars(d, "label", "value", 2).orderBy("position").collect()] == [("z", 0), ("y", 1)]
    assert [tuple(r) for r in G.table(d, rows=2, rounded=("value",)).collect()] == [("x", "1.000"), ("y", "3.000")]
    assert G.table(d, rows=1, percents=("value",)).first().value == "100.0%"


def test_limited_labelers_are_called_by_the_driver(spark):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "topic_id int, prompt string")
    waits, asked = [], []
    limiter = L.RateLimiter(LabelerConfig(min_interval_s=30, calls_per_day=2), clock=lambda: 0.0, sleep=waits.append)
    got = L.call(d, lambda p: asked.append(p) or p.upper(), limiter).orderBy("topic_id").collect()
    assert asked == ["a", "b"] and [r.reply for r in got] == ["A", "B"] and waits == [30.0]
    assert L.find("stub") is L.stub and L.find("json:dumps")("x") == '"x"'


def test_white_space_is_collapsed_like_pythons(spark):
    import re

    from agora.functions import text as T

    texts = ["", " a  b ", "a\t\nb  c　", " x    y\r\n", "plain text", None, "\x1fa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.collapse(F.col("t")).alias("c"), T.token_count(F.col("t")).alias("n")).orderBy("i").collect()
    space = f"[{T.SPACES} ]+"
    want = [None if t is None else re.sub(space, " ", t).strip(" ") for t in texts]
    assert [r.c for r in rows] == want and [r.n for r in rows] == [len((w or "").split(" ")) if w else 0 for w in want]


def test_counts_dealt_by_term_are_those_of_the_expressions(spark, monkeypatch):
    """Texts are cut into many pieces and terms into many parts; no word is exploded into a row."""
    from agora.config import TopicConfig
    from agora.operators import counting as K

    rows = [(1, "a", "The cat, the CAT's tail İstanbul Kelvin café x"), (2, "a", None), (3, "b", ""), (4, None, "one two one"), (5, "c", "the of"), (6, "b", "q"), (7, "d", "one  two\nthree " + "z" * 1000)]
    odd = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(K, "PIECE", 50_000), monkeypatch.setattr(K, "PART", 20_000)
    for d, n, stop, cfg in ((odd, 1, None, TopicConfig(min_df=1, max_df=1.0)), (odd, 3, ["the", "of"], TopicConfig(min_df=1, max_df=1.0)), (docs, 2, ["the"], TopicConfig()), (docs, 2, None, TopicConfig(max_features=7))):
        got = K.vectorized(d, "source", "text", n, stop, cfg)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = M.vectorized(M.term_counts(d, "source", M.ngrams(M.words(F.col("text")), n, stop)), cfg)
        rows_of = lambda f: sorted(map(str, f.select("topic", "term", "tf").collect()))
        assert rows_of(got) == rows_of(want) != []


def test_count_vectorizer_reads_texts_in_columns(spark):
    from agora import catalog

    assert "Generate" not in catalog.queries()["count_vectorizer"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_representatives_are_ranked_without_rows_for_words(spark):
    from agora.operators import counting as K

    docs = spark.createDataFrame([(1, "a", "car car road"), (2, "a", "car sea"), (3, "a", None), (4, "b", "sea"), (5, "c", "road"), (6, None, "car"), (7, "a", "x y")], "doc_id int, source string, text string")
    w = spark.createDataFrame([("a", "car", 0.5), ("a", "road", 0.2), ("b", "sea", 0.3), ("b", "air", 0.1)], "topic string, term string, weight double")
    like = {r._key: r._like for r in K.likeness(docs, "source", "doc_id", "text", w).collect()}
    want = {1: 1.2 / 5**0.5, 2: 0.5 / 2**0.5, 3: 0.0, 4: 0.3, 5: 0.0, 6: 0.0, 7: 0.0}
    assert like.keys() == want.keys() and all(abs(like[k] - v) < 1e-8 for k, v in want.items())
    d = M.topic_info(docs, w, "source", "text", representatives=2)
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {r.Topic: r.Representative_Docs for r in d.collect() if r.Topic} == {"a": ["car car road", "car sea"], "b": ["sea"], "c": ["road"]}


def test_top_words_of_dealt_counts_are_those_of_all(spark, monkeypatch):
    from agora.operators import counting as K

    monkeypatch.setattr(K, "PIECE", 50_000), monkeypatch.setattr(K, "PART", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows_of = lambda d: sorted((r.topic, r["rank"], r.term, r.tf, round(r.weight, 12)) for r in M.top_words(d, 10).collect())
    want = M.ctfidf(M.term_counts(docs, "source", M.ngrams(M.words(F.col("text")), 1, M.stopwords())))
    assert rows_of(K.top_weights(docs, "source", "text", M.stopwords(), 10)) == rows_of(want)


def test_keybert_in_the_hashed_space_embeds_no_document(spark):
    """Places of words are those of HashingTF, and similarities those of embedded documents."""
    import pyarrow as pa
    from pyspark.ml.feature import HashingTF
    from agora.operators import counting as K

    tokens = ["ab", "abc", "abcd", "abcde", "z" * 77]
    assert [int(h) % 256 for h in K.murmur3(pa.array(tokens))] == [HashingTF(numFeatures=256).indexOf(t) for t in tokens]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    w = M.top_words(K.top_weights(docs, "source", "text", M.stopwords(), 30), 30).drop("rank").persist()
    embed = M.embedder(docs, "text")
    want = {(r.topic, r.term): r.sim for r in M.term_similarity(embed(docs, "text"), "source", w, embed).collect()}
    got = {(r.topic, r.term): r.sim for r in M.hashed_similarity(docs, "source", "text", w).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_texts_are_split_once_for_counts_and_sums(spark, monkeypatch):
    """What is read once holds the words of topics, their counts and the hashed sums; a task deals its counts in as many rows as there are parts."""
    from agora.operators import counting as K

    rows = [(i, x, t) for i, (x, t) in enumerate([("a", "The cat, the CAT's tail İstanbul Kelvin café x"), ("a", None), ("b", ""), (None, "one two one"), ("c", "the of"), ("b", "q"), ("d", "one  two\nthree " + "z" * 1000)])]
    odd = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(K, "PIECE", 20_000), monkeypatch.setattr(K, "PART", 100_000), monkeypatch.setattr(K, "PIECE_ROWS", 3)
    of = lambda d: sorted(map(str, d.collect()))
    for d, stop in ((odd, ["the", "of"]), (odd, None), (docs.coalesce(1), M.stopwords()), (odd.filter("doc_id < 0"), None)):
        words, dealt, sums = K.read_once(d, "source", "text", stop, 32)
        assert of(words) == of(K.sizes(d, "source", "text", stop).select("topic", "words"))
        assert of(sums) == of(K.hashed_sums(d, "source", "text", 32))
        counts = dealt.groupBy("part").applyInArrow(lambda t: K.pa.table({"topic": (s := K._summed(t))[0].take(K.pa.array(s[2])), "term": s[1].take(K.pa.array(s[3])), "tf": s[4]}), "topic string, term string, tf long")
        assert of(counts.select("topic", "term", "tf")) == of(M.term_counts(d, "source", M.ngrams(M.words(F.col("text")), 1, stop)).select("topic", "term", "tf"))
        assert d is odd or dealt.groupBy("part").count().filter("count > 1").isEmpty()


def test_likeness_of_the_first_ranks_counts_few_texts(spark, monkeypatch):
    from agora.operators import counting as K

    monkeypatch.setattr(K, "PIECE", 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source"))).coalesce(1)
    w = M.top_words(K.top_weights(docs.filter("source > 'src1'"), "source", "text", M.stopwords(), 10), 10).drop("rank").persist()
    best = Window.partitionBy("_topic").orderBy(F.desc("_like"), "_key")
    first = lambda d: sorted(map(str, d.withColumn("r", F.row_number().over(best)).filter("r <= 3").collect()))
    whole, some = K.likeness(docs, "source", "doc_id", "text", w), K.likeness(docs, "source", "doc_id", "text", w, 3)
    assert first(some) == first(whole)
    listed = F.col("_topic").isin([r.topic for r in w.select("topic").distinct().collect()])
    assert some.filter(listed).count() < whole.filter(listed).count() / 3


def test_texts_of_representatives_are_not_exchanged(spark):
    docs = spark.createDataFrame([(1, "a", "car road"), (2, "b", "sea")], "doc_id int, source string, text string")
    w = spark.createDataFrame([("a", "car", 0.5), ("b", "sea", 0.3)], "topic string, term string, weight double")
    assert re.search(r"BroadcastHashJoin \[[^\]]*doc_id", M.topic_info(docs, w, "source", "text")._jdf.queryExecution().executedPlan().toString())


def test_funnel_texts_are_scored_once(spark):
    rows = [(-1, "which car", None, 5.0), (1, "Which  car", "dealer markup", 1.0), (2, "Which  car", "dealer markup", 2.0), (3, None, "", None), (4, "", None, 3.0)]
    d = spark.createDataFrame(rows, "topic_id int, topic_label_llm string, topic_summary_llm string, w double")
    columns = ["topic_id", "topic_label_llm", "topic_summary_llm", "rep_doc_centroid", "topic_weight", "is_outlier", "combined_text", "negative_signal_score", "question_signal_score", "funnel_stage", "stage_confidence", "stage_match_score", "stage_reason", "topic_display"]
    for leave_out in (True, False):
        got, want = N.assign_texts(d, "w", leave_out), N.assign_stages(N.prepare(d, "w"), leave_out)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
        assert sorted(map(str, N.pain_points(got).collect())) == sorted(map(str, N.pain_points(want).collect()))
    assert N.assign_texts(d, "w")._jdf.queryExecution().optimizedPlan().toString().count("array_contains") == 0  # the rules have been applied
