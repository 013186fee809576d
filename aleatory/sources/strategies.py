"""Composite sources over ``provider_responses(request_id, ord, name, kind, privacy, ok, latency_ms, h)``, h being hex bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import explode_bytes


def fallback(responses: DataFrame) -> DataFrame:
    """``(request_id, name, h)`` of the first in order that succeeded."""
    return responses.where("ok").groupBy("request_id").agg(F.min_by(F.struct("name", "h"), "ord").alias("w")).select("request_id", "w.*")


def race(responses: DataFrame) -> DataFrame:
    """The quickest that succeeded, ties to the earlier in order."""
    return responses.where("ok").groupBy("request_id").agg(F.min_by(F.struct("name", "h"), F.struct("latency_ms", "ord")).alias("w")).select("request_id", "w.*")


def common_kind(kind: Column) -> Column:
    return F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed")


def pessimistic_privacy(privacy: Column) -> Column:
    """Private only if all members are."""
    return F.when(F.bool_and(privacy == "private"), "private").otherwise("public")


def members(strategy: str) -> Column:
    """How many members a composite source has; an error if none."""
    return F.when(F.count("*") > 0, F.count("*")).otherwise(F.raise_error(F.lit(f"{strategy}: no_providers")).cast("bigint"))


def xor_mix(responses: DataFrame) -> DataFrame:
    """``(request_id, name, kind, privacy, h)``: byte-wise XOR of all members, of requests where all succeeded; private if any member is."""
    who = responses.groupBy("request_id").agg(
        F.bool_and("ok").alias("ok"),
        F.concat(F.lit("xor("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ","), F.lit(")")).alias("name"),
        common_kind(F.col("kind")).alias("kind"),
        F.when(F.bool_or(F.col("privacy") == "private"), "private").otherwise("public").alias("privacy"),
    )
    each = explode_bytes(responses, F.col("h"), ["request_id"]).groupBy("request_id", "pos").agg(F.bit_xor("b").alias("b"))
    mixed = each.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda s: F.lower(F.lpad(F.hex(s["b"]), 2, "0"))), "").alias("h"))
    return mixed.join(who.where("ok"), "request_id").select("request_id", "name", "kind", "privacy", "h")
