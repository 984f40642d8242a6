"""Projections, filters and reshaping of feature tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder names of damage levels and what they are called in tables.
LEVELS = {"healthy": "healthy", "damaged_low": "low", "damaged_mid": "mid", "damaged_high": "high"}
TIERS = {"healthy": "healthy", "low": "slight_moderate", "mid": "slight_moderate", "high": "severe"}
SENTINEL = -1.0


def lookup(key: Column, table: dict, default=None) -> Column:
    """A literal dictionary as an expression; ``default`` for keys that it lacks."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def strict_lookup(key: Column, table: dict, what: str = "value") -> Column:
    """The same, but a key that is neither null nor known raises an error."""
    found = lookup(key, table)
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), key))
    return F.when(key.isNull() | found.isNotNull(), found).otherwise(unknown)


def prefixed(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Every column with a prefix, but for ``keep`` and those that have it already."""
    keep = set(keep)
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep or c.startswith(prefix) else prefix + c) for c in df.columns])


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    exclude = set(exclude)
    return [c for c in df.columns if c not in exclude]


def without_prefixes(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


# Columns that say what others say, columns without signal, and sub-scores without weight.
REDUNDANT_COLOUR = tuple(f"colour_{channel}_{statistic}" for channel in ("hsv_v", "bgr_g", "bgr_r") for statistic in ("median", "iqr", "q25", "q75", "skew", "kurt"))
DEAD_FEATURES = (
    "boundary_notch_density", "deform_specular_pct", "deform_specular_blob_density", "deform_width_profile_roughness", "deform_luminance_std",
    "miner_trail_length_norm", "miner_trail_coverage_pct", "miner_trail_mean_tortuosity", "miner_trail_count", "ldsi_miner_sub",
)
ZERO_WEIGHT = ("worst_deform_luminance_std", "worst_spot_area_ratio", "worst_spot_density_per_1000px")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table without those of ``names`` that it has, such as one of the sets above."""
    return df.drop(*[f for f in df.columns if f in set(names)])


def sample_id(leaf: Column, variant: Column) -> Column:
    """The key of a leaf's variant; null if either is."""
    return F.concat(leaf.cast("string"), F.lit("__v"), variant.cast("int").cast("string"))


def image_key(species: Column, view: Column, path: Column) -> Column:
    """species_view_file of an image, by the last part of its path."""
    return F.concat(species.cast("string"), F.lit("_"), view, F.lit("_"), F.regexp_extract(path, r"([^/\\]*)$", 1))


def leaf_key(species: Column, level: Column, path: Column) -> Column:
    """species__level__stem of an image: its file's name without the last extension."""
    return F.concat(species, F.lit("__"), level, F.lit("__"), F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1))


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """A constant column if the table hasn't one of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def scrubbed(df: DataFrame, columns: Iterable[str], value: float = 0.0) -> DataFrame:
    """NaN and infinities replaced."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(value)).otherwise(F.col(c)) for c in columns})


def imputed(df: DataFrame, columns: list[str], missing: float = SENTINEL) -> DataFrame:
    """The sentinel replaced by the exact median of all other values of its column; 0 if there are none."""
    medians = df.agg(*[F.percentile(F.when(F.col(c) != missing, F.col(c)), 0.5).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))  # one row
    out = out.withColumns({c: F.when(F.col(c) == missing, F.coalesce(f"_m_{c}", F.lit(0.0))).otherwise(F.col(c)) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values}).drop(column)


def reindexed(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in this order; those that the table lacks, and nulls, are filled."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def aligned(a: DataFrame, b: DataFrame, fill: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns of either."""
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    return reindexed(a, names, fill), reindexed(b, names, fill)


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: a row for each key and column, one pass without a shuffle."""
    return df.unpivot(keys, columns, name, value)


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def coverage_check(coverage: Column, low: float = 0.02, high: float = 0.75) -> tuple[Column, Column]:
    """Whether a share of foreground is plausible, and why not."""
    ok = (coverage >= low) & (coverage <= high)
    return ok, F.when(coverage < low, F.format_string("coverage %.4f below %.4f", coverage, F.lit(low))).when(coverage > high, F.format_string("coverage %.4f above %.4f", coverage, F.lit(high))).otherwise("ok")


def decision(p: Column, threshold: float) -> tuple[Column, Column]:
    """The label of a probability, and the confidence in that label."""
    yes = p >= threshold
    return F.when(yes, "unhealthy").otherwise("healthy"), F.when(yes, p).otherwise(1 - p)


def category_of(feature: Column, rules: dict[str, str], default: str = "other") -> Column:
    """The category of the first rule whose prefix a name begins with, with view suffixes taken out."""
    name = F.regexp_replace(feature, "_top|_bottom", "")
    out = F.lit(default)
    for prefix, category in reversed(list(rules.items())):
        out = F.when(F.startswith(name, F.lit(prefix)), F.lit(category)).otherwise(out)
    return out


def path_part(path: Column, options: list[str], default: str = "unknown") -> Column:
    """The first of ``options`` that is a whole component of a path, in any case."""
    parts = F.split(F.lower(path), r"[/\\]")
    out = F.lit(default)
    for o in reversed(options):
        out = F.when(F.array_contains(parts, o), F.lit(o)).otherwise(out)
    return out
