"""Label cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fill_label(c: Column | str, label: str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(label))


def alias_labels(c: Column | str, aliases: dict[str, str]) -> Column:
    """Whole-value renames; values without an alias pass through."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for old, new in aliases.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def rewrite_prefix(c: Column | str, prefix: str, replacement: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(
        c.startswith(prefix), F.concat(F.lit(replacement), F.substr(c, F.lit(len(prefix) + 1)))
    ).otherwise(c)


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters and digits, lower-case the rest.

    ``initcap`` alone only starts words at spaces, so hyphens and brackets need the split.
    """
    c = F.col(c) if isinstance(c, str) else c
    runs = F.regexp_extract_all(
        F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1)
    )
    return F.array_join(F.transform(runs, F.initcap), "")


def null_if(c: Column | str, label: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == label, F.lit(None)).otherwise(c)
