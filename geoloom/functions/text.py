"""Names as Column expressions: cleaning, weighted edit distance, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that cleaning removes, and the cost of a substitution (an insertion or deletion is 1).
CLEANED_SIGNS = "[()（） ]"
SUBSTITUTION = 1.5


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, CLEANED_SIGNS, "")


def weighted_edit_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions cost 1, substitutions 1.5; the sum rounds half up. Null if either is null.

    One row of the table is folded over the letters of ``a``, its cells over the letters of ``b``.
    """
    left, right = _letters(a), _letters(b)
    first = F.transform(F.sequence(F.lit(0), F.size(right)), lambda x: x.cast("double"))

    def row(above: Column, letter: Column) -> Column:
        def cell(done: Column, other: Column) -> Column:
            k = F.size(done)
            change = F.element_at(above, k) + F.when(letter == other, F.lit(0.0)).otherwise(F.lit(SUBSTITUTION))
            step = F.least(F.element_at(done, -1) + 1, F.element_at(above, k + 1) + 1)
            return F.array_append(done, F.least(step, change))

        return F.aggregate(right, F.array(F.element_at(above, 1) + 1), cell)

    whole = F.aggregate(left, first, row)
    return F.when(a.isNotNull() & b.isNotNull(), F.floor(F.element_at(whole, -1) + F.lit(0.5)).cast("int"))


def _letters(x: Column) -> Column:
    """The characters; none for an empty text."""
    return F.filter(F.split(x, ""), lambda c: c != "")


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Whether the weighted distance is at most ``most``; cheap bounds go first.

    The plain distance is never above the weighted one, and Spark stops it at the threshold.
    """
    near = (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, most) >= 0)
    return F.when(near, weighted_edit_distance(a, b) <= most).otherwise(F.lit(False))


def tokens(text: Column) -> Column:
    """Words of letters and digits; runs of CJK characters are cut into pairs of neighbours."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}]+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))

    def cut(word: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda k: F.substring(word, k, F.lit(2)))
        return F.when(word.rlike(r"^[\p{IsHan}]{2,}$"), pairs).otherwise(F.array(word))

    return F.flatten(F.transform(words, cut))
