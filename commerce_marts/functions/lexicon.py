"""Sentiment and intent from word lists, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .money import as_col


def hits(text: str | Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the lower-cased text as substrings."""
    low = F.lower(as_col(text))
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])


def sentiment(text: str | Column, positive: list[str], negative: list[str]) -> Column:
    balance = F.coalesce(hits(text, positive) - hits(text, negative), F.lit(0))
    return F.when(balance > 0, "positive").when(balance < 0, "negative").otherwise("neutral")


def review_sentiment(text: str | Column) -> Column:
    return sentiment(text, fv.REVIEW_POSITIVE, fv.REVIEW_NEGATIVE)


def chat_sentiment(text: str | Column) -> Column:
    return sentiment(text, fv.CHAT_POSITIVE, fv.CHAT_NEGATIVE)


def sentiment_scores(label: str | Column) -> Column:
    """Confidence map that belongs to a label."""
    c = as_col(label)

    def as_map(scores):
        return F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(v))])

    return (
        F.when(c == "positive", as_map(fv.REVIEW_SCORES["positive"]))
        .when(c == "negative", as_map(fv.REVIEW_SCORES["negative"]))
        .otherwise(as_map(fv.REVIEW_SCORES["neutral"]))
    )


def intent(text: str | Column) -> Column:
    low = F.lower(as_col(text))
    out = None
    for label, words in fv.INTENTS:
        test = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(fv.DEFAULT_INTENT)
