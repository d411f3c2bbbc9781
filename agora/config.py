"""Settings of the stages, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases and patterns that decide which posts are kept.
BOT_AUTHOR = r"(?:^|\b)(?:auto\w*|\w*bot\w*)(?:$|\b)"
BOT_PHRASES = ("i am a bot", "this action was performed automatically", "please contact the moderators", "bot here")
GENERIC_EXACT = (
    "lol", "lmao", "lmfao", "same", "this", "agreed", "true", "yep", "yeah", "thanks", "thank you", "good point", "exactly", "for sure",
    "interesting", "nice", "wow", "damn", "idk", "i dont know", "who knows", "maybe", "depends", "fair", "makes sense", "not sure",
)
GENERIC_CONTAINS = ("thanks for sharing", "good luck", "sorry to hear that", "congrats", "congratulations", "check the wiki", "search the sub", "use the search bar")
QUICK_REACTIONS = ("", "lol", "ok", "okay", "yep", "yeah", "nah", "nope")
DELETED_AUTHORS = ("[deleted]", "deleted", "nan", "none", "")
BODY_MARKERS = ("[deleted]", "[removed]", "nan", "none")
TEXT_MARKERS = ("", "[deleted]", "[removed]", "deleted", "removed", "nan", "none")
EXTRA_STOPWORDS = (
    "http", "https", "www", "com", "amp", "html", "reddit", "subreddit", "upvote", "downvote", "deleted", "removed", "post", "comment", "thread",
    "op", "edit", "tldr", "nbsp", "x200b",
)
NEGATIONS = ("no", "nor", "not", "never", "without", "n't")


@dataclass(frozen=True)
class CorpusConfig:
    """Extraction: text rules, quality filters, dedup."""

    submission_min_tokens: int = 6
    comment_min_tokens: int = 12
    submission_min_score: float | None = 2
    comment_score_quantile: float | None = 0.25
    comment_score_floor: float = 1
    comment_score_cap: float | None = None
    min_comment_score: float | None = None
    start_year: int | None = 2014
    end_year: int | None = 2023
    drop_bots: bool = True
    drop_bot_phrases: bool = True
    drop_generic: bool = True
    generic_max_tokens: int = 16
    dedup_keys: tuple[str, ...] | None = ("is_submission", "text_clean")
    dedup_on: str | None = None
    dedup_keep: str = "first"
    repair_mojibake: bool = True


@dataclass(frozen=True)
class TopicConfig:
    """Topic model: words, clusters, embeddings."""

    ngrams: int = 2
    min_df: int = 5
    max_df: float = 0.95
    max_features: int | None = None
    top_n_words: int = 10
    components: int = 5
    min_cluster_size: int = 30
    nr_topics: int | None = None
    seed: int = 42
    mmr_diversity: float = 0.3
    embedding_version: str = "v1"
    embedding_model: str = "hashing-tf-idf"


@dataclass(frozen=True)
class RefineConfig:
    """Labels and exploration."""

    top_n_overall: int = 20
    top_n_trend: int = 10
    min_docs: int = 20
    confidence_threshold: float | None = None
    exclude_outliers: bool = True
    label_max_words: int = 8
    merge_threshold: float = 0.55
    merge_top_pairs: int = 25
    # Words that make no label by themselves, and words left out of labels.
    generic_words: tuple[str, ...] = (
        "ev", "car", "cars", "vehicle", "vehicles", "buy", "buying", "used", "new", "year", "miles", "mile", "thing", "things",
        "good", "bad", "better", "best", "need", "want", "like", "people", "look", "looking",
    )
    extra_stopwords: tuple[str, ...] = ("reddit", "subreddit", "thread", "post", "comment", "deleted", "removed", "automoderator", "amp", "nbsp", "x200b")


@dataclass(frozen=True)
class LabelerConfig:
    """Calls to an external labeler."""

    min_interval_s: float = 30.0
    calls_per_day: int = 500
    max_chars: int = 1200
    temperature: float = 0.0
