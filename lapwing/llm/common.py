"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.session import written

__all__ = ["written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges(a, b): root is the smallest vertex that can be reached.

    First every vertex joins its smallest neighbour, after which only the edges
    between different ones of these are left: where most components are stars,
    few. On those, labels move along the edges and then to the label's own
    label, so a chain shrinks by half each round; rounds end when no label
    changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    first = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("root")))
    ends = both.where("a < b").join(first.withColumnsRenamed({"v": "a", "root": "x"}), "a").join(first.withColumnsRenamed({"v": "b", "root": "y"}), "b")
    left = written(ends.where("x <> y").select("x", "y").distinct())
    if left.isEmpty():
        return first
    both = written(left.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(left.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("v")).agg(F.min("r").alias("r"))
        moved = labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("far"))
        new = written(moved.join(jump, "root", "left").select("v", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        labels = new.select("v", "root")
        if new.where("root <> was").isEmpty():
            return first.join(labels.select(F.col("root").alias("far"), F.col("v").alias("root")), "root", "left").select("v", F.coalesce("far", "root").alias("root"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Characters that take no room in print (default-ignorable code points used in running text).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
_DELETE_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))

#: Cyrillic and Greek letters that print like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
#: Letters of other scripts that only stand in when small ones of Cyrillic are taken for Latin (в, к, м, т, н look like small capitals).
_TO_LATIN = str.maketrans(LOOKALIKES)


def visible(text: str) -> str:
    """Compatibility form without characters that cannot be seen, white space runs as one blank."""
    return " ".join(unicodedata.normalize("NFKC", text.translate(_DELETE_INVISIBLE)).split())


def skeleton(text: str | None) -> str:
    """Letters and digits of a text, lower case, without accents, look-alikes brought to Latin where a word holds Latin letters."""
    if not text:
        return ""
    if not text.isascii():
        text = visible(text)
        if not text.isascii():
            words = re.split(r"(\W+)", text)
            cyrillic = sum(0x400 <= ord(c) < 0x530 for c in text)
            latin = sum(c.isalpha() and ord(c) < 0x250 for c in text)
            words = [w.translate(_TO_LATIN) if latin > cyrillic or any(c.isascii() and c.isalpha() for c in w) else w for w in words]
            text = unicodedata.normalize("NFD", "".join(words))
            text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", text.casefold()))


def distinct_strings(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
