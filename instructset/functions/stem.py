"""Porter's suffix-stripping algorithm (1980) with the extensions commonly used for ROUGE, as column
expressions for words of a-z and 0-9.

A word's shape has a vowel for each vowel and consonants for the rest: ``y`` is a vowel after a consonant. In a run of them
every second one is, so the first ``y`` after a vowel or at the start is made a consonant, then pairs are
a vowel and a consonant, and one that is left is a vowel. The rest are tests of regular expressions on the shape.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.functions.binding import bind
from instructset.session import materialize

# Irregular words, the suffixes of each step with what replaces them, and the tests of shapes.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PLURAL = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
ADJECTIVAL = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
RESIDUAL = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
UNSTEMMED_LENGTH = 3
SHAPE = (("(^|[aeiou])y", r"\1z"), ("yy", "az"), ("y", "a"))
MEASURED = "[aeiou][^aeiou]"
MEASURED_TWICE = "[aeiou]+[^aeiou]+[aeiou]+[^aeiou]"
SHORT_END = "[^aeiou][aeiou][^aeiou]$"
SHORT_WHOLE = "^[aeiou][^aeiou]$"

Step = Callable[[Column], Column]


def _shape(word: Column) -> Column:
    for pattern, new in SHAPE:
        word = F.regexp_replace(word, pattern, new.replace("\\", "$"))
    return word


def _cut(word: Column, n: int | Column) -> Column:
    """The word without its last letters."""
    return F.substring(word, F.lit(1), F.length(word) - n)


def _measured(word: Column) -> Column:
    return _shape(word).rlike(MEASURED)


def _short(word: Column, shape: Column) -> Column:
    return (shape.rlike(SHORT_END) & ~word.rlike("[wxy]$")) | shape.rlike(SHORT_WHOLE)


def _swapped(word: Column, rules: Mapping[str, str], accept: Step | None) -> Column:
    """The longest suffix that fits is replaced, if what remains is acceptable."""
    new = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in rules.items()))

    def use(suffix: Column) -> Column:
        left = _cut(word, F.length(suffix))
        whole = F.concat(left, F.try_element_at(new, suffix))
        return F.when(suffix == "", word).otherwise(whole if accept is None else F.when(accept(left), whole).otherwise(word))

    return bind(F.regexp_extract(word, f"({'|'.join(rules)})$", 1), use)


def _plural(word: Column) -> Column:
    return F.when(word.rlike("^.ies$"), _cut(word, 1)).otherwise(_swapped(word, PLURAL, None))


def _past_and_progressive(word: Column) -> Column:
    def mended(left: Column, shape: Column) -> Column:
        double = (F.length(left) > 1) & (F.substring(left, -1, 1) == F.substring(F.concat(F.lit(" "), _cut(left, 1)), -1, 1))
        once = shape.rlike(MEASURED) & ~shape.rlike(MEASURED_TWICE)
        return (
            F.when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e")))
            .when(double & shape.rlike("[^aeiou]$"), F.when(left.rlike("[lsz]$"), left).otherwise(_cut(left, 1)))
            .when(once & _short(left, shape), F.concat(left, F.lit("e")))
            .otherwise(left)
        )

    def ended(left: Column) -> Column:
        return bind(_shape(left), lambda shape: F.when(shape.rlike("[aeiou]"), mended(left, shape)).otherwise(word))

    ied = F.concat(_cut(word, 3), F.when(F.length(word) == 4, "ie").otherwise("i"))
    stripped = bind(F.regexp_replace(word, "(ed|ing)$", ""), ended)
    return (
        F.when(word.rlike("ied$"), ied)
        .when(word.rlike("eed$"), F.when(_measured(_cut(word, 3)), _cut(word, 1)).otherwise(word))
        .when(word.rlike("(ed|ing)$"), stripped)
        .otherwise(word)
    )


def _last_y(word: Column) -> Column:
    after = (F.length(word) > 2) & word.rlike("y$")
    return F.when(after & _shape(_cut(word, 1)).rlike("[^aeiou]$"), F.concat(_cut(word, 1), F.lit("i"))).otherwise(word)


def _derived(word: Column) -> Column:
    alli = word.rlike("alli$") & _measured(_cut(word, 4))

    def rest(w: Column) -> Column:
        logi = F.when(_measured(_cut(w, 3)), _cut(w, 1)).otherwise(w)
        return F.when(w.rlike("logi$"), logi).otherwise(_swapped(w, DERIVED, _measured))

    return bind(F.when(alli, _cut(word, 2)).otherwise(word), rest)


def _residual(word: Column) -> Column:
    def use(suffix: Column) -> Column:
        left = _cut(word, F.length(suffix))
        fits = (suffix != "ion") | left.rlike("[st]$")
        return F.when((suffix != "") & fits & _shape(left).rlike(MEASURED_TWICE), left).otherwise(word)

    return bind(F.regexp_extract(word, f"({'|'.join(RESIDUAL)})$", 1), use)


def _last_e(word: Column) -> Column:
    def use(left: Column) -> Column:
        def tested(shape: Column) -> Column:
            goes = shape.rlike(MEASURED_TWICE) | (shape.rlike(MEASURED) & ~_short(left, shape))
            return F.when(goes, left).otherwise(word)

        return bind(_shape(left), tested)

    return F.when(word.rlike("e$"), bind(_cut(word, 1), use)).otherwise(word)


def _last_l(word: Column) -> Column:
    left = _cut(word, 1)
    return F.when(word.rlike("ll$") & _shape(left).rlike(MEASURED_TWICE), left).otherwise(word)


STEPS: Sequence[Step] = (
    _plural,
    _past_and_progressive,
    _last_y,
    _derived,
    lambda word: _swapped(word, ADJECTIVAL, _measured),
    _residual,
    _last_e,
    _last_l,
)


def stem(word: Column) -> Column:
    """The stem of a word; words of up to two letters are their own."""

    def after(value: Column, steps: Sequence[Step]) -> Column:
        return value if not steps else bind(steps[0](value), lambda v: after(v, steps[1:]))

    irregular = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in IRREGULAR.items()))
    known = F.try_element_at(irregular, word)
    return F.when(known.isNotNull(), known).when(F.length(word) <= 2, word).otherwise(after(word, STEPS))


def token_stem(token: Column) -> Column:
    """The stem of a token as ROUGE takes it: short tokens are left alone."""
    return F.when(F.length(token) <= UNSTEMMED_LENGTH, token).otherwise(stem(token))


def stem_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token, stem`` of the distinct tokens that are not their own stem; each is stemmed once, wherever
    it occurs. The table is written, so that the test of the stem doesn't make it again."""
    spark = tokens.sparkSession
    distinct = tokens.select(F.col(token).alias("token")).where(F.length("token") > UNSTEMMED_LENGTH).distinct()
    # Small for its bytes, dear for its expressions: adaptive execution would put it into one task.
    spread = distinct.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return materialize(spread.withColumn("stem", stem(F.col("token"))), "stems").where("stem <> token")
