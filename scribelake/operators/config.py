"""Configuration as a long table: layers, precedence, origins and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.operators.joins import with_key_facts

# Allowed ranges and enumerations of policy fields.
RANGES = {
    "peak_dbfs": (-30.0, -0.1), "max_gain_db": (0.0, 60.0), "gain_db": (-120.0, 60.0),
    "temperature": (0.0, 1.0), "temperature_increment": (0.0, 1.0), "beam_size": (1, 100),
    "threads": (1, 128), "max_context": (0, 16384), "asr_workers": (1, 9), "prepare_workers": (1, 4),
    "prepared_ahead": (1, 9),
}
WHOLE = ("beam_size", "threads", "max_context", "asr_workers", "prepare_workers", "prepared_ahead")
CHOICES = {
    "channel": ["mean", "left", "right"], "candidate": ["A", "B"], "filtering": ["none"], "vad": ["false"],
    "model": ["large-v3", "large-v3-turbo"], "language": ["en"], "mode": ["auto", "serial", "pipeline"],
}
MAX_TERMS, MAX_TERM_LENGTH = 100, 200


def broken_policies(settings: DataFrame) -> DataFrame:
    """Rows (request, field, value) outside the domain of their field."""
    number = F.col("value").try_cast("double")
    ok = F.lit(None).cast("boolean")
    for name, (low, high) in RANGES.items():
        inside = number.isNotNull() & ~F.isnan(number) & (number >= low) & (number <= high)
        if name in WHOLE:
            inside = inside & F.col("value").rlike("^-?[0-9]+$")
        ok = F.when(F.col("field") == name, inside).otherwise(ok)
    for name, values in CHOICES.items():
        ok = F.when(F.col("field") == name, F.col("value").isin(values)).otherwise(ok)
    return settings.withColumn("__ok", F.coalesce(ok, F.lit(False))).where("NOT __ok").select("request_id", "field", "value")


#: Fixed value: the limit of a gain where none is set.
MAX_GAIN_DB = 30.0


def gain_above_limit(gain: Column, limit: Column) -> Column:
    return F.coalesce(gain > limit, F.lit(False))


def gains_above_limit(settings: DataFrame) -> DataFrame:
    """Requests whose fixed gain is above their own limit, a rule over two fields: ``request_id, gain_db, max_gain_db``.

    ``settings``: request_id, field, value, at most one value per field; a value that is no number sets nothing here.
    """
    number = F.col("value").try_cast("double")
    one = lambda name: F.max(F.when((F.col("field") == name) & ~F.isnan(number), number))
    both = settings.where(F.col("field").isin("gain_db", "max_gain_db")).groupBy("request_id").agg(
        one("gain_db").alias("gain_db"), F.coalesce(one("max_gain_db"), F.lit(MAX_GAIN_DB)).alias("max_gain_db")
    )
    return both.where(gain_above_limit(F.col("gain_db"), F.col("max_gain_db")))


def broken_terms(profiles: DataFrame) -> DataFrame:
    """Profiles whose glossary terms break a rule, with the rules broken."""
    terms = F.col("terms")
    checks = {
        "too_many_terms": F.size(terms) > MAX_TERMS,
        "blank_term": F.exists(terms, lambda x: F.trim(x) == ""),
        "long_term": F.exists(terms, lambda x: F.length(x) > MAX_TERM_LENGTH),
        "multiline_term": F.exists(terms, lambda x: F.contains(x, F.lit("\n"))),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return profiles.select("profile_id", F.explode(broken).alias("broken_rule"))


def unique_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of a kind by id; an id defined twice is an error row."""
    return profiles.groupBy("kind", "profile_id").agg(
        F.count(F.lit(1)).alias("definitions"), (F.count(F.lit(1)) == 1).alias("usable")
    )


def resolved(layers: DataFrame) -> DataFrame:
    """Highest layer wins per (request, field), with the origin of each value."""
    return layers.groupBy("request_id", "field").agg(
        F.max_by(F.struct("value", "origin"), F.struct("precedence", "origin")).alias("w")
    ).select("request_id", "field", "w.value", "w.origin")


def applicable_recipes(requests: DataFrame, recipes: DataFrame) -> DataFrame:
    """The single validated recipe of a request's speaker, capture and glossary; two is a conflict."""
    wanted = recipes.where((F.col("state") == "validated_for_listed_clips") & F.col("apply_to_matching_profiles"))
    key = ["speaker_id", "capture_id", "glossary_sha256"]
    per_scope = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("matches"), F.min("recipe_id").alias("recipe_id"))
    return with_key_facts(requests, per_scope, key).select(
        "request_id", F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("recipe_id")).alias("recipe_id"),
        F.coalesce(F.col("matches") > 1, F.lit(False)).alias("conflict"),
    )


def inference_settings(settings: Column) -> Column:
    """Settings that identify an inference: scheduling keys and their origins are left out."""
    return F.map_filter(settings, lambda k, v: ~k.startswith("execution.") & ~k.startswith("origins.execution."))


def merged_terms(speaker: Column, glossary: Column) -> Column:
    return F.array_distinct(F.concat(speaker, glossary))


def addable_profiles(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("kind", "profile_id").distinct(), ["kind", "profile_id"], "left_anti")
