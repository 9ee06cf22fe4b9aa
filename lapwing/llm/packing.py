"""Filling fixed-capacity containers with items (problem 7).

Sizes are tokens of a public tokenizer; a text above the capacity is cut into
full pieces and a rest, no other text is split. Packing is planned on the
histogram of sizes, which is bounded by the capacity whatever the corpus:
shallow combinations of sizes that fill a container up to a small window are
enumerated, non-negative least squares finds how often to repeat each so that
the histogram is used up, the counts are rounded down, and what is left is
packed greedily, largest first, a whole pattern at a time. Every item then finds
its container from its size and its number among the items of that size, so no
task ever holds more than a batch.

Defined cases: null or empty texts take no room and go to container 0; repeated
documents are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import written

#: Fixed value: how the byte-level tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Rules:
    tokenizer: str = os.environ.get("LAPWING_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    #: Unused tokens a planned container may have, as a share of the capacity.
    window: float = 0.002
    #: Companions tried for each size, and rounds of the least squares.
    companions: int = 12
    rounds: int = 200


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once per process."""
    if encoder.kept.get("path") != path:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder.kept = {"path": path, "own": tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})}
    return encoder.kept["own"]


encoder.kept = {}


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rules: Rules) -> list[dict[int, int]]:
    """Multiplicities of at most three sizes that fill a container up to the window."""
    window = int(rules.window * capacity)
    common = sizes[np.argsort(-counts, kind="stable")][: rules.companions]
    found: set[tuple] = set()
    for a in sizes.tolist():
        most = capacity // a
        for k in {most, most - 1, most - 2, most // 2, 1}:
            if k < 1:
                continue
            rest = capacity - k * a
            if rest <= window:
                found.add(((a, k),))
                continue
            lo, hi = np.searchsorted(sizes, rest - window), np.searchsorted(sizes, rest, "right")
            for b in sizes[max(lo, hi - 4) : hi].tolist():
                found.add(tuple(sorted(Counter({a: k, **({} if b == a else {b: 1})}).items())) if b != a else ((a, k + 1),))
            for b in common.tolist():
                left = rest - b
                if left <= 0:
                    continue
                lo, hi = np.searchsorted(sizes, left - window), np.searchsorted(sizes, left, "right")
                for c in sizes[max(lo, hi - 1) : hi].tolist():
                    found.add(tuple(sorted((Counter({a: k}) + Counter([b, c])).items())))
    return [dict(x) for x in sorted(found) if capacity - window <= sum(s * m for s, m in x) <= capacity]


def repeats(found: list[dict[int, int]], sizes: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares of the combinations against the histogram, by projected gradient with momentum."""
    place = {s: k for k, s in enumerate(sizes.tolist())}
    row = np.array([place[s] for x in found for s in x])
    col = np.repeat(np.arange(len(found)), [len(x) for x in found])
    mult = np.array([m for x in found for m in x.values()], float)
    # Scale rows by the root of the counts, so that rare sizes matter as much for their share.
    scale = 1 / np.sqrt(counts)
    value = mult * scale[row]
    target = counts * scale
    # Bound of the largest eigenvalue from row and column sums.
    step = 1 / (np.bincount(row, value).max() * np.bincount(col, value).max())
    x = np.zeros(len(found))
    y, t = x, 1.0
    for _ in range(rounds):
        error = np.bincount(row, value * y[col], len(sizes)) - target
        new = np.maximum(0, y - step * np.bincount(col, value * error[row], len(found)))
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x


def plan(histogram: dict[int, int], capacity: int, rules: Rules | None = None) -> list[tuple[dict[int, int], int]]:
    """(multiplicities by size, repeats) of containers that use the histogram up exactly."""
    rules = rules or Rules()
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(s, 0) // m for s, m in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for s, m in pattern.items():
                left[s] -= m * times

    sizes = np.array(sorted(left))
    if len(sizes):
        counts = np.array([left[s] for s in sizes.tolist()], float)
        found = combinations(sizes, counts, capacity, rules)
        if found:
            x = np.floor(repeats(found, sizes, counts, rules.rounds) + 1e-6).astype(int)
            for k in np.argsort(-x, kind="stable").tolist():
                if x[k] > 0:
                    use(found[k], int(x[k]))
    live = sorted(s for s, n in left.items() if n)
    while live:
        pattern: Counter[int] = Counter()
        room = capacity
        at = len(live)
        while at and room >= live[0]:
            at = int(np.searchsorted(live, room, "right"))
            while at and left[live[at - 1]] - pattern[live[at - 1]] <= 0:
                at -= 1
            if not at:
                break
            s = live[at - 1]
            k = min(room // s, left[s] - pattern[s])
            pattern[s] += k
            room -= k * s
        use(dict(pattern), min(left[s] // m for s, m in pattern.items()))
        live = [s for s in live if left[s]]
    return out


def containers(documents: DataFrame, limits: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(limit_name, doc_id, piece, tokens, container) of documents(doc_id, text) for limits(limit_name, capacity_tokens).

    piece is 0 for a whole text and counts the pieces of a split one from 1.
    """
    rules = rules or Rules()
    spark = documents.sparkSession
    caps = {r.limit_name: int(r.capacity_tokens) for r in limits.where("limit_name is not null and capacity_tokens > 0").select("limit_name", "capacity_tokens").distinct().collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(rules.tokenizer)
        part = TaskContext.get().partitionId()
        seen: Counter[tuple[str, int]] = Counter()
        for b in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in b["text"]]
            rows = []
            for d, n in zip(b["doc_id"].tolist(), sizes, strict=True):
                for limit, cap in caps.items():
                    pieces = [n] if n <= cap else [cap] * (n // cap) + [n % cap] * (n % cap > 0)
                    for k, size in enumerate(pieces):
                        rows.append((limit, d, k + (n > cap), size, part, seen[limit, size]))
                        seen[limit, size] += 1
            yield pd.DataFrame(rows, columns=["limit_name", "doc_id", "piece", "tokens", "part", "number"])

    docs = documents.select("doc_id", "text")
    items = written(docs.mapInPandas(measure, "limit_name string, doc_id bigint, piece int, tokens int, part int, number bigint"))
    # Numbers run on from one partition to the next within each size.
    held = items.groupBy("limit_name", "tokens", "part").agg(F.count("*").alias("n"))
    sums = held.groupBy("limit_name", "tokens").agg(F.sum("n").alias("n")).collect()
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    for r in sums:
        histogram[r.limit_name][r.tokens] = r.n
    table: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for limit, cap in caps.items():
        spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by size: first number, first container, items a container
        start: Counter[int] = Counter()
        first = 1
        for pattern, times in plan(histogram.get(limit, {}), cap, rules):
            for s, m in pattern.items():
                spans[s].append((start[s], first, m))
                start[s] += m * times
            first += times
        for s, x in spans.items():
            table[limit, s] = tuple(np.array(c, np.int64) for c in zip(*x, strict=True))
    shared = spark.sparkContext.broadcast(table)
    before = F.sum("n").over(Window.partitionBy("limit_name", "tokens").orderBy("part")) - F.col("n")
    offsets = held.select("limit_name", "tokens", "part", before.alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), np.int64)
            number = (b["number"] + b["before"]).to_numpy()
            for (limit, size), rows in b.groupby(["limit_name", "tokens"], sort=False).indices.items():
                spans = shared.value.get((limit, size))
                if spans is not None:
                    start, first, many = spans
                    at = np.searchsorted(start, number[rows], "right") - 1
                    out[rows] = first[at] + (number[rows] - start[at]) // many[at]
            yield pd.DataFrame({"limit_name": b["limit_name"].astype(object), "doc_id": b["doc_id"], "piece": b["piece"], "tokens": b["tokens"], "container": out})

    return items.join(offsets, ["limit_name", "tokens", "part"]).mapInPandas(place, "limit_name string, doc_id bigint, piece int, tokens int, container bigint")
