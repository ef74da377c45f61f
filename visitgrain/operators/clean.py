"""The cleaning chain from raw registration records to typed visits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from visitgrain.functions import text
from visitgrain.schema import (
    AMBIGUOUS_GENDER,
    COLUMNS,
    DISTRICT_ALIASES,
    EVENT_TIME,
    GENDER_ALIASES,
    REFERRAL_ALIASES,
    UNKNOWN_DISTRICT,
    VISIT_KEY,
    VISIT_SCHEMA,
)

Step = Callable[[DataFrame], DataFrame]


def project(df: DataFrame, columns: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    return df.select(*columns)


def _typed(field: T.StructField, permissive: bool) -> Column:
    c = F.col(field.name)
    if permissive:
        return c.try_cast(field.dataType).alias(field.name)
    return c.cast(field.dataType).alias(field.name)


def convert_types(
    df: DataFrame, schema: T.StructType = VISIT_SCHEMA, mode: str = "strict"
) -> DataFrame:
    """Cast every schema column. Bad values raise, or become null with ``mode="permissive"``."""
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode must be 'strict' or 'permissive', not {mode!r}")
    others = [c for c in df.columns if c not in schema.names]
    return df.select(*[_typed(f, mode == "permissive") for f in schema.fields], *others)


def fill_unknown(df: DataFrame, column: str = "kabupaten", label: str = UNKNOWN_DISTRICT) -> DataFrame:
    return df.withColumn(column, text.fill_label(column, label))


def rename_values(df: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumn(column, text.alias_labels(column, dict(aliases)))


def rename_districts(df: DataFrame, column: str = "kabupaten") -> DataFrame:
    fixed = text.alias_labels(column, DISTRICT_ALIASES)
    return df.withColumn(column, text.rewrite_prefix(fixed, "KABUPATEN", "KAB."))


def title_case(df: DataFrame, column: str = "kabupaten") -> DataFrame:
    return df.withColumn(column, text.title_case(column))


def blank_label(
    df: DataFrame, column: str = "jenis_kelamin", label: str = AMBIGUOUS_GENDER
) -> DataFrame:
    return df.withColumn(column, text.null_if(column, label))


def dedupe_by_key(
    df: DataFrame, key: str = VISIT_KEY, order: Sequence[str] = (EVENT_TIME,), hot_keys: bool = False
) -> DataFrame:
    """One row per key: the least by ``order``, then by the remaining columns.

    The survivor does not depend on partitioning. Keys are nearly unique as a rule, so rows are
    dealt by key first and sorted once. With ``hot_keys`` the minimum is taken before the shuffle
    too: that sorts every row twice, but a key repeated very often is reduced where it lies.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    df = df if hot_keys else df.repartition(F.col(key))
    kept = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return kept.select(*[key if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def drop_known(rows: DataFrame, table: DataFrame, key: str = VISIT_KEY) -> DataFrame:
    """Rows whose key the table does not hold.

    Keys present on both sides are found first: new rows below the broadcast threshold are sent
    to the table's files, which then need no shuffle. At most the new rows' own keys come back.
    """
    repeated = table.select(key).join(rows.select(key), key, "left_semi").distinct()
    return rows.join(repeated, key, "left_anti").select(*rows.columns)


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort_for_write(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    """Order inside each partition, which is what Parquet statistics need; no shuffle."""
    return df.sortWithinPartitions(ts)


def cleaning_steps(drop_ambiguous: bool = False) -> list[Step]:
    """The chain in its fixed order."""
    steps: list[Step] = [fill_unknown, rename_districts, title_case]
    if drop_ambiguous:
        steps.append(blank_label)
    return [
        *steps,
        dedupe_by_key,
        lambda d: rename_values(d, "rujukan", REFERRAL_ALIASES),
        lambda d: rename_values(d, "jenis_kelamin", GENDER_ALIASES),
    ]


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return reduce(lambda d, step: d.transform(step), steps, df)


def clean(df: DataFrame, mode: str = "strict", drop_ambiguous: bool = False) -> DataFrame:
    """Project, cast, then clean. Casting first keeps bad records from winning a dedupe."""
    typed = convert_types(project(df), mode=mode)
    return run_steps(typed, cleaning_steps(drop_ambiguous))


def before_dedupe(df: DataFrame, mode: str = "strict") -> DataFrame:
    """What ``clean`` does up to its dedupe; ``after_dedupe`` is the rest."""
    steps = cleaning_steps()
    return run_steps(convert_types(project(df), mode=mode), steps[: steps.index(dedupe_by_key)])


def is_typed(df: DataFrame, schema: T.StructType = VISIT_SCHEMA) -> bool:
    """True where ``convert_types`` has nothing to cast."""
    return all(f.name in df.columns and df.schema[f.name].dataType == f.dataType for f in schema.fields)


def after_dedupe(df: DataFrame) -> DataFrame:
    steps = cleaning_steps()
    return run_steps(df, steps[steps.index(dedupe_by_key) + 1 :])
