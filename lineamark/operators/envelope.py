"""Signature envelopes round a receipt, and the context that fills in who made what with which model."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the algorithms and the canonical form; where keys may be; encodings of signatures.
ALGORITHM, HASH, FORM = "Ed25519", "SHA-256", "RFC8785-like/1.0"
BACKENDS, ENCODINGS = ("local", "kms", "hsm", "external_kms"), ("base64", "base64url", "hex")
UNSIGNED, NO_KEY, NO_HASH = "unsigned", "none", "0" * 64


def envelope(
    payload_hash: Column,
    signed_at: Column,
    signature: Column | None = None,
    key_id: Column | None = None,
    backend: str = "local",
    encoding: str = "base64",
    service: str | None = None,
    public_key: str | None = None,
    method: str | None = None,
) -> Column:
    """A struct round a hash. Without a signature it says that it is unsigned; optional names that are null are left out of its JSON."""
    if backend not in BACKENDS or encoding not in ENCODINGS:
        raise ValueError(f"backend must be one of {BACKENDS}, encoding one of {ENCODINGS}")
    if (signature is None) != (key_id is None):
        raise TypeError("a signature and the id of its key go together")
    optional = {"signing_service": service, "public_key_ref": public_key, "verification_method": method}
    meta = [
        F.lit(ALGORITHM).alias("signature_algorithm"),
        (F.lit(NO_KEY) if key_id is None else key_id).alias("key_id"),
        F.lit(FORM).alias("canonicalization_version"),
        F.lit(backend).alias("key_backend"),
    ]
    meta += [F.lit(v).alias(k) for k, v in optional.items() if v is not None]
    value = F.lit(UNSIGNED) if signature is None else signature
    return F.struct(
        payload_hash.alias("payload_hash"),
        F.lit(HASH).alias("hash_algorithm"),
        value.alias("signature_value"),
        F.lit(encoding).alias("signature_encoding"),
        signed_at.alias("signed_at"),
        F.struct(*meta).alias("metadata"),
    )


def placeholder(signed_at: Column) -> Column:
    """An envelope for what isn't signed yet."""
    return envelope(F.lit(NO_HASH), signed_at, F.lit(""), F.lit(UNSIGNED))


def covers(e: Column, receipt: Column) -> Column:
    """Whether an envelope is for this receipt and bears a signature."""
    return (e["payload_hash"] == receipt) & ~e["signature_value"].isin("", UNSIGNED)


@dataclass(frozen=True)
class Context:
    """Who made something, with which model."""

    model_id: str
    model_version: str
    actor_id: str

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Context:
        """From AI_MODEL_ID, AI_MODEL_VERSION and USER_ID or USERNAME; a ValueError names what is missing."""
        env = os.environ if env is None else env
        model, version, actor = env.get("AI_MODEL_ID"), env.get("AI_MODEL_VERSION"), env.get("USER_ID") or env.get("USERNAME")
        for name, value in (("AI_MODEL_ID", model), ("AI_MODEL_VERSION", version), ("USER_ID or USERNAME", actor)):
            if not value:
                raise ValueError(f"{name} must be set")
        return cls(model, version, actor if ":" in actor else f"user:{actor}")


def resolved(rows: DataFrame, context: Context | None = None) -> DataFrame:
    """rows with model_id, model_version and actor_id: their own where they have them, else the context's.

    Without a context rows must have all three columns; a null in one of them then fails the job.
    """
    out = rows
    for name in ("model_id", "model_version", "actor_id"):
        own = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        if context is None and name not in rows.columns:
            raise ValueError(f"{name} is neither a column nor in a context")
        other = F.raise_error(F.lit(f"{name} is null and there is no context")) if context is None else F.lit(getattr(context, name))
        out = out.withColumn(name, F.coalesce(own, other.cast("string")))
    return out
