"""Whole evidence records: identity, hashes of both states, fingerprints, watermark, metadata, receipt.

A receipt is the SHA-256 of the record's canonical JSON: keys in alphabetical order, nothing between, nulls written,
UTF-8. to_json writes fields as they are declared, so the structs here are declared in that order. Signature, receipt and
the fragment set are no part of what the receipt covers.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineamark.functions.text import TAG, marked, normalized_sha, sha, watermark_id
from lineamark.tables import free_name, written

#: The confidence of an anchor fingerprint, the least entropy declared for a set of fragments.
ANCHOR_CONFIDENCE, LEAST_ENTROPY = 0.95, 0.6


def canonical(record: Column) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false"})


def receipt(record: Column) -> Column:
    return sha(canonical(record))


def hex_of(simhash: Column) -> Column:
    """A SimHash as sixteen small hex digits."""
    return F.lower(F.lpad(F.hex(simhash), 16, "0"))


def alphabetical(**fields: Column) -> Column:
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


def evidence_records(
    docs: DataFrame,
    simhashes: DataFrame,
    anchor_hashes: DataFrame,
    fragment_sets: DataFrame,
    key: str,
    text: str,
    ids: Column,
    prompt: Column,
    url: Column,
    model: Column,
    version: Column,
    actor: Column,
    created: Column,
    style: str = "footer",
) -> DataFrame:
    """key, evidence (struct, with fragment_set), receipt, marked: a whole record for each row of docs.

    simhashes: key, before, after (hex); anchor_hashes: key, anchor_hash; fragment_sets: key, fragments (array of
    fragment_id, entropy); rows that lack these have nulls in their place.
    """
    t, tag, none = F.col(text), watermark_id(F.col(key)), F.lit(None).cast("string")
    after = marked(t, tag, url, style)
    own = docs.select(
        key,
        ids.alias("artifact_id"),
        tag.alias("tag"),
        url.alias("url"),
        prompt.alias("prompt"),
        model.alias("model"),
        version.alias("version"),
        actor.alias("actor"),
        created.alias("created"),
        t.alias("text"),
        after.alias("marked"),
    )
    own = own.select(
        "*",
        sha(F.col("text")).alias("before"),
        sha(F.col("marked")).alias("after"),
        normalized_sha(F.col("text")).alias("norm_before"),
        normalized_sha(F.col("marked")).alias("norm_after"),
        sha(F.col("prompt")).alias("prompt_hash"),
    )
    sims = simhashes.select(key, F.col("before").alias("sim_before"), F.col("after").alias("sim_after"))
    own = own.join(sims, key, "left").join(anchor_hashes, key, "left").join(fragment_sets, key, "left")
    c = F.col
    print_of = lambda algorithm, value, role, confidence: alphabetical(algorithm=F.lit(algorithm), value=value, role=F.lit(role), confidence=confidence)
    unsure = F.lit(None).cast("double")
    record = alphabetical(
        artifact_id=c("artifact_id"),
        artifact_type=F.lit("text"),
        mime_type=F.lit("text/plain"),
        created_at=c("created"),
        model_id=c("model"),
        model_version=c("version"),
        actor_id=c("actor"),
        prompt_hash=c("prompt_hash"),
        output_hash_raw=c("before"),
        output_hash_distributed=c("after"),
        watermark=alphabetical(
            watermark_id=c("tag"), watermark_type=F.lit("visible"), tag_text=F.concat(F.lit(TAG), c("tag")), verification_url=c("url"), qr_payload=none, embed_method=F.lit(f"{style}_append_v1"), removal_resistance=F.lit("low"), location=F.lit(style)
        ),
        hashes=alphabetical(content_hash_before_watermark=c("before"), content_hash_after_watermark=c("after"), canonical_receipt_hash=none, normalized_hash_before=c("norm_before"), normalized_hash_after=c("norm_after"), perceptual_hash_before=none, perceptual_hash_after=none, simhash_before=c("sim_before"), simhash_after=c("sim_after")),
        fingerprints=F.array(
            print_of("simhash", c("sim_before"), "exact_content_before_watermark", unsure),
            print_of("simhash", c("sim_after"), "exact_content_after_watermark", unsure),
            print_of("distinctive_anchor_v1", c("anchor_hash"), "forensic_anchor_before_watermark", F.lit(ANCHOR_CONFIDENCE)),
        ),
        metadata=alphabetical(distribution_state=F.lit("watermarked"), artifact_format_version=F.lit("1.0"), watermark_style=F.lit(style), text_length_before=F.length("text"), text_length_after=F.length("marked")),
        prior_receipt_hash=none,
    )
    fragments = F.when(
        F.col("fragments").isNotNull(),
        F.struct(
            F.size("fragments").alias("fragment_count"),
            F.lit(LEAST_ENTROPY).alias("min_entropy_threshold"),
            F.col("fragments").alias("fragments"),
        ),
    )
    out = own.select(key, record.alias("record"), fragments.alias("fragment_set"), "marked")
    fields = [f.name for f in out.schema["record"].dataType.fields]
    return out.select(
        key,
        F.struct(*(F.col(f"record.{f}").alias(f) for f in fields), "fragment_set").alias("evidence"),
        receipt(F.col("record")).alias("receipt"),
        "marked",
    )


def zipped(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows of left and right at the same place in their orders, with place (from 0); a ValueError if counts differ.

    Places come from a sort by ranges and the counts of its partitions, not from one task that numbers all rows.
    Orders should be total: rows that tie may come in any order.
    """

    def placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
        part, at = free_name(df, "part_"), free_name(df, "at_")
        rows = written(
            df.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
            "placed",
        )
        counts = rows.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect()  # a row for each partition
        begins = [0, *accumulate(r["n"] for r in counts)]
        begin = F.create_map(
            *(F.lit(x) for r, b in zip(counts, begins, strict=False) for x in (r[part], b))
        ) if counts else F.create_map(F.lit(0), F.lit(0))
        return rows.withColumn("place", begin[F.col(part)] + F.col(at)).drop(part, at), begins[-1]

    (x, n), (y, m) = placed(left, order_left), placed(right, order_right)
    if n != m:
        raise ValueError(f"{n} rows and {m} rows can't be zipped")
    return x.join(y, "place")
