"""Row predicates, as columns, so that they can be combined and pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.functions.binding import bind
from instructset.functions.text import has_text, word_count

# The accepted range of description lengths in words, both ends excluded.
MIN_DESCRIPTION_WORDS = 50
MAX_DESCRIPTION_WORDS = 300


def described_in_locale(locale: Column, description: Column, wanted: str = "us") -> Column:
    return F.coalesce(locale == wanted, F.lit(False)) & has_text(description)


def product_quality(title: Column, description: Column, bullets: Column) -> Column:
    """A description that is there, is not a copy of title or bullets, and says more
    than the title."""
    present = title.isNotNull() & description.isNotNull() & bullets.isNotNull()
    return F.coalesce(
        present
        & (description != title)
        & (description != bullets)
        & (word_count(title) < word_count(description)),
        F.lit(False),
    )


def description_band(
    title: Column,
    description: Column,
    low: int = MIN_DESCRIPTION_WORDS,
    high: int = MAX_DESCRIPTION_WORDS,
) -> Column:
    """``description`` is the list of parts as found, before any markup is removed."""
    sizes = F.struct(
        word_count(F.array_join(description, " ")).alias("description"),
        word_count(title).alias("title"),
    )
    fits = bind(
        sizes,
        lambda n: (n["description"] > low)
        & (n["description"] < high)
        & (n["description"] > n["title"]),
    )
    return F.coalesce((F.size(description) > 0) & fits, F.lit(False))


def both_present(first: Column, second: Column) -> Column:
    return first.isNotNull() & second.isNotNull()


def both_filled(first: Column, second: Column) -> Column:
    return has_text(first) & has_text(second)


def within_length(ids: Column, limit: int) -> Column:
    return F.size(ids) <= limit


def instruction_only(marker: Column) -> Column:
    return F.coalesce(marker == 0, F.lit(False))


def valid_mixed(marker: Column, system: Column, prompt: Column, response: Column) -> Column:
    """Marker and prompt are always needed, system message and response only where the
    row is an instruction."""
    return (
        marker.isNotNull()
        & prompt.isNotNull()
        & ((marker == 1) | (system.isNotNull() & response.isNotNull()))
    )


def sentiment(rating: Column) -> Column:
    return (
        F.when(rating < 3.0, F.lit("negative"))
        .when(rating > 3.0, F.lit("positive"))
        .when(rating == 3.0, F.lit("neutral"))
    )


def partition_rows(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and the rejects; a null predicate rejects."""
    passed = F.coalesce(predicate, F.lit(False))
    return df.filter(passed), df.filter(~passed)
