"""Reading and writing tables: Parquet, CSV with an encoding fallback, reports, dead letters, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only the columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header, in UTF-8, or in windows-1252 if its bytes are not UTF-8.

    Spark puts U+FFFD where bytes don't decode, so a search for that character in the text columns decides; the header
    names are checked against the required ones first.
    """

    def read(encoding: str) -> DataFrame:
        return spark.read.csv(path, header=True, schema=schema, encoding=encoding, mode="PERMISSIVE", enforceSchema=False)

    df = read("UTF-8")
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    text = [c for c, t in df.dtypes if t == "string"]
    broken = F.lit(False)
    for c in text:
        broken = broken | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
    if not text or df.filter(broken).limit(1).isEmpty():
        return df
    # Spark reads ISO 8859-1, which has control characters where windows-1252 has 27 letters and signs
    controls = [chr(b) for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")]
    letters = "".join(c.encode("latin-1").decode("cp1252") for c in controls)
    return read("ISO-8859-1").withColumns({c: F.translate(F.col(f"`{c}`"), "".join(controls), letters) for c in text})


def union_of_keys(parts: list[DataFrame], first: tuple[str, ...] = ()) -> DataFrame:
    """All rows of tables with different columns: ``first``, then every further column as it is first seen; missing is null."""
    if not parts:
        raise ValueError("no tables to unite")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    head = [c for c in first if c in out.columns]
    return out.select(*head, *[c for c in out.columns if c not in head])


def write_projections(features: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """A feature table in full and, beside it, as the classifier wants it (without ``drop``)."""
    features.write.mode("overwrite").option("header", True).csv(f"{path}/full")
    features.drop(*drop).write.mode("overwrite").option("header", True).csv(f"{path}/classifier")


def split_failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters: rows whose error struct (type, reason) is set, flattened."""
    good = rows.filter(F.col(error).isNull()).drop(error)
    bad = rows.filter(F.col(error).isNotNull()).withColumns({"fail_type": F.col(f"{error}.type"), "reason": F.col(f"{error}.reason")}).drop(error)
    return good, bad


def run_summary(rows: DataFrame, group: str, ok: str) -> DataFrame:
    """One row: total, successes, success_rate in percent to two places, failures by group as JSON."""
    by_group = rows.groupBy(group).agg(F.count_if(~F.col(ok)).alias("bad"), F.count("*").alias("n"))
    failures = F.sort_array(F.collect_list(F.when(F.col("bad") > 0, F.struct(F.col(group).alias("name"), "bad"))))
    out = by_group.agg(F.sum("n").alias("total"), F.sum(F.col("n") - F.col("bad")).alias("successes"), F.to_json(F.map_from_entries(failures)).alias("failures"))
    rate = F.bround(100.0 * F.col("successes") / F.greatest("total", F.lit(1)), 2)
    return out.select(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce(rate, F.lit(0.0)).alias("success_rate"), "failures")


def write_json_rows(rows: DataFrame, path: str) -> None:
    """One JSON document a row, nulls left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, columns: list[str], order: str) -> None:
    """A report: chosen columns, sorted, as CSV parts whose order is the file order."""
    rows.select(*columns).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)
