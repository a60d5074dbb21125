"""Tables in the folder that driver and executors share: the library's own; and samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineamark.tables import HOT, free_name, looked_up, new_path, remove, shared_dir, small_batches, written

__all__ = ["HOT", "free_name", "least_hashed", "looked_up", "new_path", "remove", "shared_dir", "small_batches", "written"]


def least_hashed(keys: DataFrame, sample: int) -> DataFrame:
    """The sample rows of keys (distinct; h, a hash, i and any others) that are least by (h, i).

    Of many keys only those below an edge are sorted, about four times as many as are asked for, so that what each
    partition sends on doesn't grow with the table; should there be too few, all are.
    """
    total = keys.count()
    if total > 16 * sample:
        near = keys.where(F.col("h") < int(-(2**63) + 2**64 * (4 * sample / total)))
        if near.limit(sample).count() == sample:
            keys = near
    return keys.orderBy("h", "i").limit(sample)
