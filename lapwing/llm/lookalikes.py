"""Visually identical text with different characters (problem 6).

Text is brought to compatibility form without characters that cannot be seen.
What then still mixes scripts is searched as a lattice: each letter may stay or
become a letter that prints alike, and Viterbi picks the path with the best
character bigram score, where every change of script within a word and every
replaced letter costs. The bigrams are counted over all texts of the corpus;
the table is bounded by the square of the alphabet, not by the corpus.

Defined cases: null and ASCII-only texts are their own form; an empty corpus
leaves all bigrams equally likely, so scripts alone decide.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import INVISIBLE, LOOKALIKES

#: Code points below this are counted as themselves (Latin, Greek and Cyrillic blocks lie here), the others as one class.
WIDTH = 1536
SCRIPT_CHANGE = 8.0
REPLACED = 1.5
#: Compatibility characters that are proper typography, and hyphens that stand in for the common one.
PROPER = "…²³¹ªº™½¼¾№€℃℉µ"
HYPHENS = "‐‑⁃﹣－˗"
_HYPHEN = dict.fromkeys(map(ord, HYPHENS), "-")
_GONE = dict.fromkeys(map(ord, INVISIBLE))

_FROM: dict[str, set[str]] = {}
for _other, _latin in LOOKALIKES.items():
    _FROM.setdefault(_latin, set()).add(_other)
    _FROM.setdefault(_other, set()).add(_latin)
for _latin in list(LOOKALIKES.values()):
    for _a in _FROM[_latin]:
        _FROM[_a] |= _FROM[_latin] - {_a}


def script(c: str) -> str:
    """Script of a letter, '' for anything else."""
    if not c.isalpha():
        return ""
    n = ord(c)
    if n < 0x370 or 0x1E00 <= n < 0x1F00:
        return "L"
    if n < 0x400 or 0x1F00 <= n < 0x2000:
        return "G"
    if n < 0x530 or 0x1C80 <= n < 0x1C90:
        return "C"
    return "X"


class Bigrams:
    """Log probabilities of the second character given the first, from counts of pairs."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.counts = counts
        self.total: dict[int, int] = {}
        for (a, _), n in counts.items():
            self.total[a] = self.total.get(a, 0) + n

    def __call__(self, a: str, b: str) -> float:
        x, y = min(ord(a), WIDTH), min(ord(b), WIDTH)
        return math.log((self.counts.get((x, y), 0) + 0.05) / (self.total.get(x, 0) + 0.05 * 200))


def _word(word: str, after: str, main: str, score: Bigrams) -> str:
    """The best path through the look-alikes of one word."""
    if len(word) == 1 and script(word) == "G" and after[:1] in ("-", "‐", "‑", "–"):
        return word  # a Greek letter used as a symbol
    steps = [[c, *sorted(_FROM.get(c, ()))] for c in word]
    paths = {" ": (0.0, "", "")}
    for i, (c, options) in enumerate(zip(word, steps, strict=True)):
        best: dict[str, tuple[float, str, str]] = {}
        for o in options:
            s = script(o)
            own = -REPLACED * (o != c) - 0.5 * SCRIPT_CHANGE * (s not in ("", main) and i == 0)
            for last, (value, text, was) in paths.items():
                v = value + own + score(last, o) - SCRIPT_CHANGE * (s != "" and was != "" and s != was)
                if o not in best or v > best[o][0]:
                    best[o] = (v, text + o, s or was)
        paths = best
    return max(((v + score(last, " "), text) for last, (v, text, _) in paths.items()), key=lambda x: (x[0], x[1]))[1]


def canonical(text: str | None, score: Bigrams) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii():
        return text
    kept = {c: c for c in PROPER}
    out = "".join(kept.get(c) or unicodedata.normalize("NFKC", c) if c in PROPER or not unicodedata.combining(c) else c for c in text.translate(_GONE).translate(_HYPHEN))
    out = "".join(" " if c.isspace() and c not in "\t\n\r\f\v" or unicodedata.category(c) == "Zs" else c for c in out)
    out = unicodedata.normalize("NFC", out)
    scripts = [script(c) for c in out]
    held = {s for s in scripts if s}
    if len(held) > 1:
        main = max(sorted(held), key=scripts.count)
        parts = re.split(r"([^\W\d_]+[̀-ͯ]*)", out)
        for i in range(1, len(parts), 2):
            w = parts[i]
            if any(script(c) not in ("", main) for c in w):
                parts[i] = _word(w, parts[i + 1], main, score)
        out = unicodedata.normalize("NFC", "".join(parts))
    return out


def bigram_counts(texts: DataFrame, column: str) -> Bigrams:
    """Counts over all texts of a column; what the driver gets is at most WIDTH² sums, in practice a few thousand."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = WIDTH + 1
        sums = np.zeros(side * side, np.int64)
        for b in batches:
            text = " " + " ".join(b[column].dropna()) + " "
            codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), WIDTH).astype(np.int64)
            sums += np.bincount(codes[:-1] * side + codes[1:], minlength=side * side)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": at, "n": sums[at]})

    pairs = texts.select(column).mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return Bigrams({divmod(int(r.pair), WIDTH + 1): int(r.n) for r in pairs.collect()})


def look_alikes(df: DataFrame, id_cols: list[str], column: str, score: Bigrams) -> DataFrame:
    """Rows whose text is not in its one form, with that form as `form`."""
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in id_cols) + ", form string"

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            form = [canonical(t, score) for t in b[column]]
            at = [k for k, (f, t) in enumerate(zip(form, b[column], strict=True)) if f != t]
            if at:
                yield pd.DataFrame({c: b[c].to_numpy()[at] for c in id_cols} | {"form": [form[k] for k in at]})

    mixed = df.select(*id_cols, column).where(F.col(column).rlike(r"[^\x00-\x7F]"))  # an ASCII text is its own form
    return mixed.mapInPandas(change, schema)
