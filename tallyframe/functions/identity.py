"""Keys and seeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON writes it, quotes and backslashes escaped, other than ASCII as \\u escapes."""
    quoted = F.regexp_replace(value, r'(["\\])', r"\\$1")
    coded = F.transform(F.split(quoted, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))))
    return F.concat(F.lit('"'), F.when(quoted.rlike(r"[^\x00-\x7f]"), F.array_join(coded, "")).otherwise(quoted), F.lit('"'))


def stable_uid(model: Column, strategy: Column, dataset: Column, index: Column, seed: Column, config_hash: Column, length: int = 16) -> Column:
    """Key of one measurement: a prefix of the SHA-256 of its coordinates as sorted JSON."""
    text = F.format_string(
        '{"config_hash": %s, "dataset": %s, "index": %d, "model": %s, "schema": 1, "seed": %d, "strategy": %s}',
        json_text(config_hash), json_text(dataset), index.cast("long"), json_text(model), seed.cast("long"), json_text(strategy),
    )
    return F.substring(F.sha2(text, 256), 1, length)


def stable_hash(value: Column, length: int = 16) -> Column:
    """The hash of a plain string."""
    return F.substring(F.sha2(json_text(value), 256), 1, length)


def example_seed(seed: Column, index: Column) -> Column:
    """A seed of its own for every example of a run."""
    return F.pmod(seed.cast("long") * 1_000_003 + index.cast("long") * 7919, F.lit(2**31 - 1))


def model_family(model: Column) -> Column:
    """The organisation before a slash, else what comes before the first hyphen."""
    return F.lower(F.when(model.contains("/"), F.substring_index(model, "/", 1)).otherwise(F.substring_index(model, "-", 1)))


def bootstrap_unit(template_id: Column, item_id: Column) -> Column:
    return F.coalesce(F.nullif(template_id, F.lit("")), item_id)


def path_component(name: Column) -> Column:
    """A name fit for one folder on any system."""
    return F.regexp_replace(F.regexp_replace(name, "/", "__"), r"[^A-Za-z0-9._=-]+", "_")
