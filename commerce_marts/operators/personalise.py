"""One row of personalisation per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .joins import lookup


def personalisation(segments: DataFrame, behaviour: DataFrame, hints: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Segment, campaign texts, shopping behaviour, hints and the recommended product ids (at most a page)."""
    seg = F.col("segment")
    greeting = F.coalesce(lookup(F.col("time_preference"), fv.GREETINGS), F.lit(""))
    subtitle = F.concat(greeting, lookup(seg, {k: v[1] for k, v in fv.SEGMENT_CAMPAIGNS.items()}))
    page = recommendations.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_id"))).alias("r"))
    df = segments.join(behaviour, "user_id").join(hints, "user_id", "left").join(page, "user_id", "left")
    return df.select(
        "user_id", "segment", lookup(seg, {k: v[0] for k, v in fv.SEGMENT_CAMPAIGNS.items()}).alias("title"), subtitle.alias("subtitle"),
        lookup(seg, {k: v[2] for k, v in fv.SEGMENT_CAMPAIGNS.items()}).alias("call_to_action"), "time_preference", "cart_abandonment_rate", "hints",
        F.transform("r", lambda x: x["product_id"]).alias("recommended"),
    )
