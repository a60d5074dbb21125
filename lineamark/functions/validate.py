"""Validators: each gives an error or null; lists of errors are "field: error" in the order of the fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineamark.functions import text as T

#: Kinds of watermarks, how well they resist removal.
WATERMARK_TYPES = ("none", "visible", "metadata", "embedded", "hybrid", "qr_code")
RESISTANCE = ("low", "medium", "high")


def listed(errors: list[Column]) -> Column:
    """Those that are not null, as an array."""
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def named(field: str, error: Column) -> Column:
    return F.concat(F.lit(f"{field}: "), error)


def fragment_errors(fragment: Column) -> list[Column]:
    """Of one fragment (fragment_id, entropy): null or 'fragment <id>: error', for its id and its entropy."""
    head = F.concat(F.lit("fragment "), F.coalesce(fragment["fragment_id"], F.lit("")), F.lit(": "))
    return [F.concat(head, T.fragment_id_error(fragment["fragment_id"])), F.concat(head, T.unit_error(fragment["entropy"], "entropy_score"))]


def fragment_set_errors(declared: Column, threshold: Column, fragments: Column) -> Column:
    """Of a set: its declared count, its threshold, and each of its fragments in turn."""
    n = F.size(fragments)
    count = F.when(
        declared != n,
        F.concat(F.lit("fragment_count mismatch: declared "), declared.cast("string"), F.lit(", actual "), n.cast("string")),
    )
    limit = F.when(~threshold.between(0, 1), F.concat(F.lit("min_entropy_threshold must be 0.0-1.0, got "), threshold.cast("string")))
    each = F.flatten(F.transform(fragments, lambda f: F.filter(F.array(*fragment_errors(f)), lambda e: e.isNotNull())))
    return F.concat(listed([count, limit]), each)


def descriptor_errors(watermark_id: Column, kind: Column, resistance: Column) -> Column:
    levels = "[" + ", ".join(f"'{x}'" for x in RESISTANCE) + "]"
    return listed(
        [
            named("watermark_id", T.watermark_id_error(watermark_id)),
            F.when(~F.coalesce(kind.isin(*WATERMARK_TYPES), F.lit(False)), "watermark_type must be WatermarkType enum"),
            F.when((resistance != "") & ~resistance.isin(*RESISTANCE), F.concat(F.lit(f"removal_resistance must be one of {levels}, got "), resistance)),
        ]
    )


def evidence_errors(e: Column) -> Column:
    """Of a whole evidence record, as lineamark.operators.evidence makes it; fragments (fragment_set) may be null."""
    hashes = [(f, e[f]) for f in ("prompt_hash", "output_hash_raw", "output_hash_distributed")]
    hashes += [(f"hashes.{f}", e["hashes"][f]) for f in ("content_hash_before_watermark", "content_hash_after_watermark")]
    own = [
        named("artifact_id", T.artifact_id_error(e["artifact_id"])),
        named("created_at", T.timestamp_error(e["created_at"])),
        *(named(f, T.sha_error(h)) for f, h in hashes),
        named("watermark.watermark_id", T.watermark_id_error(e["watermark"]["watermark_id"])),
    ]
    some = e["fragment_set"]
    return F.concat(
        listed(own),
        F.coalesce(fragment_set_errors(some["fragment_count"], some["min_entropy_threshold"], some["fragments"]), F.array().cast("array<string>")),
    )


def checks(e: Column, signature: Column) -> Column:
    """The six checks of a compliance report."""
    before, after = (F.coalesce(e["hashes"][f], F.lit("")) != "" for f in ("content_hash_before_watermark", "content_hash_after_watermark"))
    return F.struct(
        T.artifact_id_error(e["artifact_id"]).isNull().alias("artifact_id_format"),
        T.watermark_id_error(e["watermark"]["watermark_id"]).isNull().alias("watermark_id_format"),
        T.timestamp_error(e["created_at"]).isNull().alias("timestamp_format"),
        (before & after).alias("dual_state_hashes_present"),
        e["fragment_set"].isNotNull().alias("forensic_fragments_present"),
        F.coalesce(signature != "", F.lit(False)).alias("signature_present"),
    )


def compliance(e: Column, signature: Column) -> Column:
    """is_compliant, error_count, errors and the checks, flat."""
    errors = evidence_errors(e)
    return F.struct(
        e["artifact_id"].alias("artifact_id"),
        (F.size(errors) == 0).alias("is_compliant"),
        F.size(errors).alias("error_count"),
        errors.alias("errors"),
        checks(e, signature).alias("checks"),
    )
