"""The kernels as functions of a session, for SQL: simhash, minhash, char_entropy, and the table function fragments_of."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lineamark.operators import fingerprint as P


def by_text(kernel, kind: str):
    """An Arrow-batched function of a column of texts; the kernel is made once for each batch of a task."""

    @F.pandas_udf(kind)
    def f(texts: pd.Series) -> pd.Series:
        made = kernel()
        return texts.map(lambda t: made(None if t is None else t))

    return f


class FragmentsOf:
    """fragments_of(text): location, offset_start, offset_end, fragment, sha, entropy."""

    def eval(self, text: str):
        for f in P.fragments_of(text or ""):
            yield f["location"], f["offset_start"], f["offset_end"], f["fragment"], f["sha"], f["entropy"]


def register(spark: SparkSession) -> None:
    spark.udf.register("simhash", by_text(P.simhash_kernel, "long"))
    spark.udf.register("minhash", by_text(P.minhash_kernel, "array<bigint>"))
    spark.udf.register("char_entropy", by_text(lambda: P.char_entropy, "double"))
    spark.udtf.register(
        "fragments_of",
        F.udtf(FragmentsOf, returnType="location: string, offset_start: int, offset_end: int, fragment: string, sha: string, entropy: double"),
    )
