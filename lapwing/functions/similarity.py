"""String similarities. Jaro and the longest common substring run Arrow-batched over distinct pairs; all else is built in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lapwing.params import Params


def jaro(a: str, b: str) -> float:
    """Textbook Jaro: greedy matches from the left within half the longer length, transpositions halved and rounded down."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common substring: a length is feasible if all shorter ones are, so bisect on sets of windows."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        own = {a[i : i + mid] for i in range(len(a) - mid + 1)}
        if any(b[i : i + mid] in own for i in range(len(b) - mid + 1)):
            lo = mid
        else:
            hi = mid - 1
    return lo


_SCORES = StructType([StructField("jaro", DoubleType()), StructField("lcs", IntegerType())])


@F.pandas_udf(_SCORES)
def _jaro_lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        yield pd.DataFrame({"jaro": [jaro(x or "", y or "") for x, y in zip(a, b, strict=True)], "lcs": [lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)]})


def pair_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, jaro, lcs) once per distinct pair of strings."""
    return pairs.select(a, b).distinct().withColumn("x", _jaro_lcs(F.col(a), F.col(b))).select(a, b, "x.jaro", "x.lcs")


def enhanced_score(a: str, b: str, p: Params) -> float:
    """`enhanced` of two strings."""
    j = jaro(a, b)
    if not j:
        return 0.0
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    score, common = j + prefix * p.jw_prefix * (1 - j), lcs_length(a, b)
    if common >= p.jw_window:
        score += p.jw_suffix * min(1.0, common / max(min(len(a), len(b)), 1)) * (1 - score)
    return max(0.0, min(1.0, score))


def field_scores(p: Params):
    """Arrow UDF of (title, title, venue, venue, authors, authors), all in lower case and trimmed: the struct of their similarities; authors: mean of each one's best match."""

    @F.pandas_udf("title double, venue double, authors double")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], float] = {}

        def one(a: str, b: str) -> float:
            got = known.get((a, b))
            if got is None:
                if len(known) > 500_000:  # it only remembers
                    known.clear()
                got = known[a, b] = enhanced_score(a, b, p)
            return got

        for t, u, v, w, x, y in batches:
            authors = [sum(max((one(m, n) for n in b), default=0.0) for m in a) / len(a) if len(a) and len(b) else 0.0 for a, b in zip(x, y, strict=True)]
            yield pd.DataFrame({"title": [*map(one, t, u)], "venue": [*map(one, v, w)], "authors": authors}, dtype=float)

    return scores


def windows(text: Column, size: int) -> Column:
    """All substrings of this length, in order; none if the text is shorter or size is not positive."""
    none = F.array().cast("array<string>")
    return none if size <= 0 else F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(none)


def common_substring(a: str, b: str) -> str:
    """The longest common substring, the first in `a` of several."""
    n = lcs_length(a or "", b or "")
    return next((a[i : i + n] for i in range(len(a) - n + 1) if a[i : i + n] in b), "") if n else ""


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """Length of the common beginning, four at most."""
    steps = [F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))), 1).otherwise(0) for k in range(1, most + 1)]
    return sum(steps[1:], steps[0])


def jaro_winkler(j: Column, a: Column, b: Column, scale: float = 0.10) -> Column:
    """Always boosted by the common beginning, whatever the Jaro similarity."""
    return j + common_prefix(a, b) * F.lit(scale) * (1 - j)


def enhanced(j: Column, lcs: Column, a: Column, b: Column, p: Params) -> Column:
    """Jaro-Winkler with a bonus for a long common substring; 0 if nothing matches."""
    score = jaro_winkler(j, a, b, p.jw_prefix)
    ratio = F.least(F.lit(1.0), lcs / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    lifted = F.when(lcs >= p.jw_window, score + p.jw_suffix * ratio * (1 - score)).otherwise(score)
    return F.when(j == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lifted)))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
