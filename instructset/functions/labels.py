"""Tagged tokens: extraction from text, BIO labels and entity spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from instructset.functions.binding import bind
from instructset.functions.text import WHITESPACE

# Fixed value: the pattern of one "token, label" tuple, with \\w and \\s written as
# Unicode classes. Group 1 is the token, group 2 the label.
_W = r"[\p{L}\p{N}_]"
_S = rf"[{WHITESPACE}]"
TUPLE = rf"({_W}+),{_S}+([BI]-{_W}+|O)"
_TO_THE_END = (1 << 31) - 1


def tuple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TUPLE), F.lit(1))


def tuple_labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TUPLE), F.lit(2))


def zip_tags(tokens: Column, tags: Column) -> Column:
    return F.zip_with(tokens, tags, lambda t, l: F.struct(t.alias("token"), l.alias("label")))


def aligned_labels(predicted: Column, true: Column) -> Column:
    """Predicted labels; all ``O`` where their number does not fit."""
    return F.when(F.size(predicted) == F.size(true), predicted).otherwise(
        F.array_repeat(F.lit("O"), F.size(true))
    )


def entity_spans(labels: Column, strict: bool = False) -> Column:
    """``array<struct<type, begin, end>>`` of the entities in one label sequence.

    An entity starts at ``B``, at ``I`` after ``O`` and at a change of type, and ends
    before the next start or ``O``. With ``strict`` only ``B`` starts an entity, and an
    ``I`` that continues nothing belongs to none.
    """
    size = F.size(labels)

    def placed(label: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), label.alias("label"))

    # Most labels are O and leave at once; what follows sees only the others.
    inside = F.filter(F.transform(labels, placed), lambda e: e["label"] != "O")

    def split(found: Column) -> Column:
        """Entities from ``found``, the labels that are not O, with their places."""
        count = F.size(found)
        before = F.concat(
            F.array(F.struct(F.lit(-2).alias("at"), F.lit("O").alias("label"))),
            F.slice(found, 1, F.greatest(count - 1, F.lit(0))),
        )

        def kind(entry: Column) -> Column:
            return F.substring(entry["label"], 3, _TO_THE_END)

        def mark(entry: Column, last: Column) -> Column:
            opens = entry["label"].startswith("B")
            fresh = (last["at"] + 1 < entry["at"]) | (kind(last) != kind(entry))
            return F.struct(
                entry["at"].alias("begin"),
                F.when(opens | F.lit(not strict), kind(entry)).alias("type"),
                (opens | fresh).alias("starts"),
                last["at"].alias("before"),
            )

        starts = F.filter(F.zip_with(found, before, mark), lambda m: m["starts"])

        def close(begun: Column) -> Column:
            """An entity ends where the label before the next start stands."""
            ends = F.concat(
                F.transform(
                    F.slice(begun, 2, F.greatest(F.size(begun), F.lit(1))), lambda m: m["before"]
                ),
                F.array(F.get(found, count - 1)["at"]),
            )
            return F.zip_with(
                begun,
                ends,
                lambda m, end: F.when(
                    m["type"].isNotNull(),
                    F.struct(m["type"].alias("type"), m["begin"].alias("begin"), end.alias("end")),
                ),
            )

        return F.array_compact(bind(starts, close))

    return F.when(size > 0, F.filter(bind(inside, split), lambda e: e["type"].isNotNull()))


def conll_block(tokens: Column) -> Column:
    """``token label`` lines of one sentence and a closing newline; a text sink adds one
    more, which makes the empty line between sentences."""
    lines = F.transform(tokens, lambda t: F.concat(t["token"], F.lit(" "), t["label"]))
    return F.when(
        F.size(tokens) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    ).otherwise(F.lit(""))
