"""Duplicates hidden by formatting differences (problem 5).

Each record gets a canonical key that forgets white space, letter case,
punctuation, field order and a DOI's resolver. Records are range-partitioned on
(key digest, id), each partition is sorted by Spark's external sort, and one
scan over adjacent records compares the full keys. A run that goes on over a
partition border - a hot key simply fills several partitions - is stitched
through the first and last run of every partition, at most two rows per
partition, so no key is ever gathered in one task.

Defined cases: records whose required text is null or blank take no part; a
null other field equals a blank one; records with equal ids count once; equal
records keep the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import partitions, written

#: Letters whose upper case is written with two letters, and the final sigma.
FOLDS = (("ß", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ŉ", "ʼn"))
#: What stands before the identifier proper: a resolver's address or a "doi" label.
DOI_LEAD = r"(?:https?\s*:\s*/+\s*[^\s/]+\s*/+\s*(?=10\s*\.)|\b(?:info\s*:\s*)?doi\b[\s:./=]*(?:org[\s/]+)?(?=10\s*\.))"


def folded(c: Column) -> Column:
    c = F.lower(c)
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("i̇"), F.lit("i"))


def word_list(c: Column) -> Column:
    """The words of a text, in order, whatever stands between them."""
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}\p{M}]+"), lambda x: x != "")


def doi_key(c: Column) -> Column:
    """Lower-case identifier from '10.' on; null if missing."""
    low = F.lower(F.regexp_replace(c, r"\s+", ""))
    core = F.regexp_extract(low, r"(10\..*)$", 1)
    core = F.regexp_replace(F.when(core == "", low).otherwise(core), r"[\s.,;:)\]}>\"']+$", "")
    return F.when(core != "", core)


def canonical_key(raw: Column, title: Column, doi: Column) -> Column:
    """Words of the raw entry in any order, words of the title in order, identifier."""
    bag = F.array_join(F.array_sort(word_list(F.regexp_replace(folded(F.coalesce(raw, F.lit(""))), DOI_LEAD, " "))), " ")
    return F.concat_ws("\n", F.array_join(word_list(title), " "), F.coalesce(doi_key(doi), F.lit("")), bag)


def adjacent_runs(keyed: DataFrame) -> DataFrame:
    """(keep_id, id) of every record of keyed(id, key): keep_id is the smallest id of its key."""
    spark = keyed.sparkSession
    n = partitions(spark)
    id_type = dict(keyed.dtypes)["id"]
    # Written before the range is sampled, or the keys would be computed a second time.
    records = written(keyed.select(F.xxhash64("key").alias("h"), "id", "key"))
    runs = records.repartitionByRange(n, "h", "id").sortWithinPartitions("h", "key", "id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The open run: its key and smallest id. edge is 1 while the run may go on before this partition, and 2 if it may go on after it.
        part = TaskContext.get().partitionId()
        key, keep, run = None, None, 0
        head, last = None, None  # first and last digest
        ends: dict[int, tuple] = {}  # key and smallest id of the runs of the last digest
        for b in batches:
            if not len(b):
                continue
            keys, digests = b["key"].to_numpy(), b["h"].to_numpy()
            head = digests[0] if head is None else head
            ids = b["id"].to_numpy()
            new = np.ones(len(b), bool)
            new[1:] = keys[1:] != keys[:-1]
            if key is not None and keys[0] == key:
                new[0] = False
            starts = np.flatnonzero(new)
            number = np.cumsum(new) + run
            first = np.empty(len(b), ids.dtype)
            if not new[0]:
                first[: starts[0] if len(starts) else len(b)] = keep
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                first[s:e] = ids[s]
            key, keep, run = keys[-1], first[-1], int(number[-1])
            if digests[-1] != last:
                last, ends = digests[-1], {}
            for x in np.flatnonzero(new & (digests == last)).tolist():
                ends[int(number[x])] = (keys[x], first[x])
            if not new[0] and digests[0] == last:
                ends[int(number[0])] = (keys[0], first[0])
            # Only runs of the first and of the last digest can go on in a neighbour: rows of the first carry the key at once,
            # the keys of the last follow as rows without id when the partition ends.
            yield pd.DataFrame({"part": part, "run": number, "keep_id": first, "id": ids, "key": np.where(digests == head, keys, None)})
        if ends and last != head:
            yield pd.DataFrame({"part": part, "run": list(ends), "keep_id": [k for _, k in ends.values()], "id": pd.array([None] * len(ends), dtype="Int64") if id_type in ("bigint", "int") else [None] * len(ends), "key": [k for k, _ in ends.values()]})

    scanned = written(runs.mapInPandas(scan, f"part int, run bigint, keep_id {id_type}, id {id_type}, key string"))
    # One row per border run (two a partition, but for keys that share a digest), then one row per key that meets a border.
    border = scanned.where("key is not null").groupBy("part", "run", "key").agg(F.min("keep_id").alias("keep_id"))
    whole = border.groupBy("key").agg(F.min("keep_id").alias("first_id"), F.collect_set(F.struct("part", "run")).alias("at")).where(F.size("at") > 1)
    stitched = whole.select(F.explode("at").alias("at"), "first_id").select("at.part", "at.run", "first_id")
    members = scanned.where("id is not null").drop("key")
    return members.join(stitched, ["part", "run"], "left").select(F.least("keep_id", F.coalesce("first_id", "keep_id")).alias("keep_id"), "id")


def form_duplicates(df: DataFrame, id_col: str = "citation_id", raw: str = "raw", title: str = "title", doi: str = "doi") -> DataFrame:
    """(keep_id, id) for every record with a title; members of one set share keep_id."""
    used = df.where(F.size(word_list(F.col(title))) > 0)
    return adjacent_runs(used.select(F.col(id_col).alias("id"), canonical_key(F.col(raw), F.col(title), F.col(doi)).alias("key")))


def representatives(members: DataFrame) -> DataFrame:
    """One row per set with its exact number of copies."""
    return members.groupBy("keep_id").agg(F.countDistinct("id").alias("copies"))
