"""Token totals that are kept up to date by signed changes.

A batch holds documents that were added and documents that were removed; a revised document is
removed with its old count and added with its new one. A batch is summed by source, language and
tokenizer version before it is stored. One manifest, replaced as a whole, names the stored sums that
count and the ids of the batches in them: a batch that is sent again is left out, also after its sums were merged
with others, and a crash before the manifest is written leaves the totals as they were. Sums are merged by
size class as batches come, so totals are read from a few small folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batch_sums import BatchSums

KEYS = ["source", "lang", "tokenizer"]


def signed(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Sums of a batch: KEYS, documents and tokens, removed rows counting below zero.

    Both frames have KEYS and tokens. A null key is a value like any other, null tokens count 0,
    rows that repeat count each. Sums without effect are left out.
    """
    parts = [f.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (sign * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")) for f, sign in ((added, 1), (removed, -1)) if f is not None]
    if not parts:
        raise ValueError("a batch needs added or removed rows")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 OR tokens <> 0")


class TokenRollup:
    """Totals in a shared folder. One writer at a time; a writer that was stopped sends its batch again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.sums = BatchSums(spark, path, "source string, lang string, tokenizer string, documents long, tokens long", KEYS)

    def commit(self, batch_id: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Store a batch once; False if its id is known already, whatever the rows are."""
        return self.sums.commit(batch_id, signed(added, removed))

    def totals(self) -> DataFrame:
        """KEYS, documents and tokens of all documents that are there now; keys without documents are left out."""
        return self.sums.totals().filter("documents <> 0 OR tokens <> 0")

    def fold(self, upto: int | None = None) -> None:
        """Merge stored sums now instead of when enough have come; ids stay known, so ``upto`` changes nothing any more."""
        self.sums.compact(fan_in=2)
