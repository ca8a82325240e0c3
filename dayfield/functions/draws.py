"""Random numbers from keys: the same on every rerun, whatever the partitioning, and in every SQL engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number in 0..1 (1 excluded) from the text of the keys."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weighted_key(u: Column, weight: Column) -> Column:
    """The n smallest of these keys are n rows drawn without replacement with chances in proportion to the weights."""
    return -F.log(F.greatest(u, F.lit(1e-12))) / weight
