"""Forum text analytics on Spark: canonical documents, topics, exploration, funnels and figures."""

__all__ = ["explore_all", "extract"]


def __getattr__(name: str):
    """The two stages by name; they are imported when asked for, so that workers load only what they use."""
    if name in __all__:
        from agora.plans import stages

        return getattr(stages, name)
    raise AttributeError(name)
