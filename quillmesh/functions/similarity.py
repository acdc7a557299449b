"""String similarities. All but Jaro are built-in expressions; Jaro is sequential per pair and runs in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import col, similarity_tokens


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = F.lower(col(a)), F.lower(col(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / F.when(longest == 0, 1).otherwise(longest))


def _grams(text: Column, n: int) -> Column:
    t = F.trim(F.lower(text))
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))))


def dice(a: Column | str, b: Column | str, n: int = 2) -> Column:
    """Dice over the sets of n-grams; a shorter string is its own gram."""
    x, y = _grams(col(a), n), _grams(col(b), n)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = F.array_distinct(similarity_tokens(a)), F.array_distinct(similarity_tokens(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.when(both == 0, 1).otherwise(both))


def containment(a: Column | str, b: Column | str) -> Column:
    """Shorter by longer length where one holds the other, else 0."""
    x, y = F.trim(F.lower(col(a))), F.trim(F.lower(col(b)))
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when((short > 0) & (F.contains(x, y) | F.contains(y, x)), short / F.when(long_ > 0, long_).otherwise(1)).otherwise(0.0)


def jaro_value(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    crossed = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_value((x or "").lower().strip(), (y or "").lower().strip()) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Jaro, raised by a tenth of the rest for each of up to four equal first characters; always raised."""
    x, y = F.trim(F.lower(col(a))), F.trim(F.lower(col(b)))
    prefix = sum((F.when(F.least(F.length(x), F.length(y)) >= k, (F.substring(x, 1, k) == F.substring(y, 1, k)).cast("int")).otherwise(0) for k in range(2, 5)), F.when(F.least(F.length(x), F.length(y)) >= 1, (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int")).otherwise(0))
    j = jaro(col(a), col(b))
    return j + prefix * 0.1 * (1.0 - j)


def composite(a: Column | str, b: Column | str) -> Column:
    """Weighted: .4 Jaro-Winkler, .3 bigrams, .3 tokens; with containment above a half .3, .2, .2 and .3 of it."""
    jw, ng, tok, inside = jaro_winkler(a, b), dice(a, b), token_jaccard(a, b), containment(a, b)
    return F.when(inside > 0.5, 0.3 * jw + 0.2 * ng + 0.2 * tok + 0.3 * inside).otherwise(0.4 * jw + 0.3 * ng + 0.3 * tok)


def similar(a: Column | str, b: Column | str, threshold: float = 0.7) -> Column:
    return composite(a, b) >= threshold


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else 0), row[j]
            best = max(best, row[j])
    return best


@F.pandas_udf(DoubleType())
def _common_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x, y) / max(len(x), len(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """Shorter by longer length where one holds the other, else the longest common substring by the longer length."""
    inside = containment(a, b)
    return F.when(inside > 0, inside).otherwise(_common_ratio(F.trim(F.lower(col(a))), F.trim(F.lower(col(b)))))
