"""Token-id arrays: masks, truncation, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label that a loss function ignores.
IGNORE = -100


def mask_prompt(ids: Column, prompt_size: Column, ignore: int = IGNORE) -> Column:
    """Labels: the first ``prompt_size`` ids are ignored, the others kept."""
    size = F.least(F.size(ids), prompt_size.cast("int"))
    return F.concat(
        F.array_repeat(F.lit(ignore), size), F.slice(ids, size + F.lit(1), F.size(ids))
    )


def truncate(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def pad_to(ids: Column, width: Column, pad: int) -> Column:
    """``ids`` filled up to ``width``; longer arrays stay as they are."""
    return F.concat(ids, F.array_repeat(F.lit(pad), width.cast("int") - F.size(ids)))


def round_up(width: Column, multiple: int | None) -> Column:
    if not multiple:
        return width
    return (F.ceil(width / F.lit(multiple)) * multiple).cast("int")


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def ignore_padding(ids: Column, pad: int, ignore: int = IGNORE) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def restore_padding(ids: Column, pad: int, ignore: int = IGNORE) -> Column:
    return F.transform(ids, lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))


def filled_size(ids: Column, pad: int) -> Column:
    """Number of ids that are not padding."""
    return F.size(F.filter(ids, lambda x: x != pad))
