"""Evaluation texts leaking into training text (problem 8).

The held-out items are the small side, bounded by ``max_items`` and
``max_words`` (both checked); their BM25 inverted index - a term is a pair of
neighbouring words, its postings are cut into blocks of items, each with its
greatest impact - goes to every executor. Every document is cut into overlapping passages over its whole text
and every passage is a query. Retrieval is block-max WAND for a batch of
passages at once: the terms of a passage stand in the order of their greatest
impact, its pivot is where the running sum reaches the threshold, only blocks
with a posting at or behind the pivot are looked at, those whose maxima cannot
reach their threshold are left, and in the others every item at or above its
own threshold is a candidate. A candidate counts once enough consecutive words
of the item are found in order, in which some may be misspelt or replaced, and
its unbroken pairs bring a share of what the run's pairs weigh: passages cut to
one pattern share all but their telling words, so most of the weight lies in
pairs that hold one. A changed word breaks two pairs, so the share asked for is
what four changed words of sixteen leave. All weights follow from shares of the
items, so they are the same for a set of any size.

Stock phrases that many items share carry no weight and are left out of the
items before indexing. Defined cases: null or empty texts hold nothing; items
without words of their own are never found; repeated documents give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import INVISIBLE

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{1,60}>|&[a-z]{2,8};|&#\d{1,6};")
_SPEAKER = re.compile(r"(?m)^[ \t]*(?:USER|ASSISTANT|SYSTEM)[ \t]*:")
_UNSEEN = re.compile(f"[{INVISIBLE}]")
_GONE = dict.fromkeys(map(ord, INVISIBLE))


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii() and _UNSEEN.search(text):
        text = text.translate(_GONE)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "USER" in text or "ASSISTANT" in text or "SYSTEM" in text:
        text = _SPEAKER.sub(" ", text)
    return _WORD.findall(text.casefold())


@dataclass
class Rules:
    """run: consecutive words an item must share; hits: how many of them must be the same or misspelt; known: share of the weight of a run's pairs that the unbroken ones must bring; power: of the rarity in a pair's weight, so that a pattern's common words can't outweigh the telling ones; stock_share, stock_words: word runs of this length in this share of items (eight at least) are stock."""

    run: int = 16
    hits: int = 12
    known: float = 0.4
    power: float = 2.0
    stock_words: int = 6
    stock_share: float = 0.03
    passage: int = 32
    step: int = 16
    block: int = 16
    k1: float = 1.2
    b: float = 0.3
    max_items: int = 20_000
    max_words: int = 4_000_000


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, `size` of them, and whose they are."""
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size - start, size), own


def _firsts(sorted_ids: np.ndarray) -> np.ndarray:
    """Where a new number begins."""
    return np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.zeros(0, np.int64)


@dataclass
class Index:
    rules: Rules
    items: dict[object, list[str]]
    words: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = self.rules
        self.items = self._without_stock(self.items)
        self.ids = sorted(i for i, w in self.items.items() if len(w) >= r.run)
        self.items = {i: self.items[i] for i in self.ids}
        n = len(self.ids)
        self.words = {w: k for k, w in enumerate(sorted({w for own in self.items.values() for w in own}))}
        # Copies of an item count once, or its own words would pass for common ones.
        texts = {tuple(w) for w in self.items.values()}
        self.df = Counter(w for own in texts for w in set(own))
        held = Counter(x for own in texts for x in set(pairwise(own)))
        self.weight = {x: math.log(1 + (len(texts) - d + 0.5) / (d + 0.5)) ** r.power for x, d in held.items()}
        mean = sum(map(len, self.items.values())) / max(n, 1)
        gain = [(r.k1 + 1) / (1 + r.k1 * (1 - r.b + r.b * len(w) / mean)) for w in self.items.values()]
        impact, most = [], dict.fromkeys(self.weight, 0.0)
        for k, own in enumerate(self.items.values()):
            for x, tf in Counter(pairwise(own)).items():
                brings = self.weight[x] * tf * (r.k1 + 1) / (tf + (r.k1 + 1) / gain[k] - 1)
                impact.append((x, k, brings))
                most[x] = max(most[x], brings)
        # Terms are numbered by rising maximum, so that a sorted passage has its pivot where the running sum reaches the threshold.
        terms = {x: t for t, x in enumerate(sorted(most, key=lambda x: (most[x], x)))}
        self.termmax = np.array([most[x] for x in terms], np.float32)
        known = sorted((self.words[a] * len(self.words) + self.words[b], t) for (a, b), t in terms.items())
        self.pair_key = np.array([*(k for k, _ in known), -1], np.int64)
        self.pair_term = np.array([*(t for _, t in known), -1], np.int64)
        rows = sorted((terms[x], k, brings) for x, k, brings in impact)
        self.posting = np.array([k for _, k, _ in rows], np.int32)
        self.impact = np.array([x for _, _, x in rows], np.float32)
        # The blocks of each term: key, first posting, greatest impact.
        self.blocks = -(-n // r.block)
        key = np.array([t for t, _, _ in rows], np.int64) * self.blocks + self.posting // r.block
        first = _firsts(key)
        self.block_key = key[first]
        self.block_start = np.append(first, len(key))
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.float32)
        self.term_start = np.searchsorted(self.block_key, np.arange(len(terms) + 1) * self.blocks) if n else np.zeros(1, np.int64)
        # A run lies whole within some passage, and its unbroken pairs bring the share `known` of its weight.
        self.threshold = np.array([0.999 * gain[k] * self._least(own) for k, own in enumerate(self.items.values())], np.float32)
        self.block_floor = np.minimum.reduceat(self.threshold, np.arange(0, n, r.block)) if n else np.zeros(0, np.float32)
        self.floor = float(self.threshold.min(initial=np.inf))

    def _least(self, own: list[str]) -> float:
        """What the pairs of a run must bring at least."""
        w = np.array([self.weight[x] for x in pairwise(own)])
        return self.rules.known * float(np.convolve(w, np.ones(self.rules.run - 1), "valid").min())

    def _without_stock(self, items: dict[object, list[str]]) -> dict[object, list[str]]:
        k = self.rules.stock_words
        shared = Counter(g for w in items.values() for g in {tuple(w[s : s + k]) for s in range(len(w) - k + 1)})
        most = max(8, self.rules.stock_share * len(items))
        out = {}
        for i, w in items.items():
            stock = [False] * len(w)
            for s in range(len(w) - k + 1):
                if shared[tuple(w[s : s + k])] >= most:
                    stock[s : s + k] = [True] * k
            out[i] = [x for x, y in zip(w, stock, strict=True) if not y]
        return out

    def size(self) -> int:
        """Bytes of postings and blocks."""
        return sum(x.nbytes for x in (self.pair_key, self.pair_term, self.posting, self.impact, self.block_key, self.block_start, self.block_max, self.term_start, self.threshold, self.termmax))

    def candidates(self, docs: list[list[str]]) -> dict[int, dict[int, list[int]]]:
        """By document, the items at or above the threshold with the starts of the passages where they are."""
        r, none = self.rules, len(self.words)
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        sizes = np.array([len(w) if len(w) >= r.run else 0 for w in docs], np.int64)
        if not self.ids or not sizes.any():
            return found
        number = self.words.get
        ids = np.array([number(x, none) for w, n in zip(docs, sizes.tolist(), strict=True) if n for x in w], np.int64)
        # Every document is laid out in steps; a passage is a step and those behind it, within the document.
        width = -(-r.passage // r.step)
        steps = -(-sizes // r.step)
        base = np.cumsum(steps) - steps
        pair = (ids[:-1] < none) & (ids[1:] < none)
        pair[np.cumsum(sizes[sizes > 0])[:-1] - 1] = False
        at = np.flatnonzero(pair)
        key = ids[at] * none + ids[at + 1]
        where = np.searchsorted(self.pair_key[:-1], key)
        held = self.pair_key[where] == key
        at, term = at[held], self.pair_term[where[held]]
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at, "right")
        step = base[doc] + (at - (ends - sizes)[doc]) // r.step
        total = int(steps.sum())
        owner = np.repeat(np.arange(len(sizes)), steps)
        told = np.append(np.bincount(step, self.termmax[term], total), np.zeros(width))
        last = np.append(base + steps, total)[owner]
        bound = sum(np.where(np.arange(total) + k < last, told[k : total + k], 0) for k in range(width))
        live = np.append(bound >= self.floor, np.zeros(width, bool))
        # The terms of each passage that may reach the threshold, once each, by rising maximum.
        pairs = []
        for k in range(width):
            p = step - k
            ok = p >= 0
            ok[ok] = live[p[ok]] & (owner[p[ok]] == owner[step[ok]])
            pairs.append(p[ok] * len(self.termmax) + term[ok])
        pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
        passage, term = np.divmod(pairs, len(self.termmax))
        if not len(passage):
            return found
        # Pivot: what comes before it cannot reach the threshold alone.
        first = _firsts(passage)
        size = np.diff(np.append(first, len(passage)))
        most = self.termmax[term] * times
        running = np.cumsum(most, dtype=np.float64)
        running -= np.repeat(running[first] - most[first], size)
        behind = np.flatnonzero(running >= self.floor)
        number = np.repeat(np.arange(len(first)), size)
        spans = self.term_start[term[behind]], self.term_start[term[behind] + 1] - self.term_start[term[behind]]
        held, own = _spread(*spans)
        cands = np.unique(number[behind[own]] * self.blocks + self.block_key[held] % self.blocks)
        for a in range(0, len(cands), 1 << 16):
            p, b = np.divmod(cands[a : a + (1 << 16)], self.blocks)
            # The maxima of the block's terms, then the postings of the blocks that may reach their threshold.
            entry, own = _spread(first[p], size[p])
            key = term[entry] * self.blocks + b[own]
            where = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            there = self.block_key[where] == key
            where, own, qtf = where[there], own[there], times[entry[there]]
            may = np.bincount(own, self.block_max[where] * qtf, len(p)) >= self.block_floor[b]
            kept = may[own]
            where, own, qtf = where[kept], own[kept], qtf[kept]
            post, mine = _spread(self.block_start[where], self.block_start[where + 1] - self.block_start[where])
            item = self.posting[post]
            score = np.bincount(own[mine] * r.block + item % r.block, self.impact[post] * qtf[mine], len(p) * r.block)
            limit = np.full(self.blocks * r.block, np.inf, np.float32)
            limit[: len(self.threshold)] = self.threshold
            hit = np.flatnonzero(score >= limit[(b[:, None] * r.block + np.arange(r.block)).ravel()])
            for c, k in zip(*(x.tolist() for x in np.divmod(hit, r.block)), strict=True):
                q = int(passage[first[p[c]]])
                found[int(owner[q])][int(b[c]) * r.block + k].append((q - int(base[owner[q]])) * r.step)
        return found

    def holds(self, words: list[str], item: int) -> bool:
        """True if some run of item words stands in these words in order, most of it unchanged."""
        r, own = self.rules, self.items[self.ids[item]]
        n = len(own)
        where: dict[str, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            where[w].append(p)
        diagonals = Counter(p - q for q, w in enumerate(own) for p in where.get(w, ()))
        weight = np.array([self.weight[x] for x in pairwise(own)])
        for diagonal in sorted(diagonals, key=lambda d: (-diagonals[d], d)):
            if sum(diagonals.get(diagonal + k, 0) for k in (-2, -1, 0, 1, 2)) < r.hits - 4:
                continue
            hit, whole = np.zeros(n), np.zeros(n - 1)
            for q in range(max(0, -2 - diagonal), min(n, len(words) + 2 - diagonal)):
                w, lo = own[q], max(diagonal + q - 2, 0)
                around = words[lo : lo + 6]
                same = [x for x in range(min(5, len(around))) if around[x] == w]
                hit[q] = bool(same) or len(w) > 4 and any(close(w, x) for x in around[:5])
                whole[q : q + 1] = any(around[x + 1 : x + 2] == own[q + 1 : q + 2] for x in same)
            hits = np.convolve(hit, np.ones(r.run), "valid")
            brought, most = (np.convolve(x, np.ones(r.run - 1), "valid") for x in (whole * weight, weight))
            if ((hits >= r.hits) & (brought >= r.known * most)).any():
                return True
        return False


@lru_cache(maxsize=1 << 18)
def close(a: str, b: str) -> bool:
    """One edit or one swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def leaked(docs: DataFrame, items: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(doc_id, item_id) of docs(doc_id, text) that hold a passage of items(item_id, text)."""
    rules = rules or Rules()
    rows = items.select("item_id", "text").where("text is not null and item_id is not null").dropDuplicates(["item_id"]).limit(rules.max_items + 1).collect()
    if len(rows) > rules.max_items:
        raise ValueError(f"more than {rules.max_items} held-out items: raise Rules.max_items once the index is known to fit the executors")
    read = {x.item_id: tokens(x.text) for x in rows}
    if sum(map(len, read.values())) > rules.max_words:
        raise ValueError(f"held-out items of more than {rules.max_words} words: raise Rules.max_words once the index is known to fit the executors")
    shared = docs.sparkSession.sparkContext.broadcast(Index(rules, read))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for b in batches:
            for a in range(0, len(b), 256):
                ids = b["doc_id"].iloc[a : a + 256]
                texts = [tokens(t) for t in b["text"].iloc[a : a + 256]]
                out = []
                for d, cands in index.candidates(texts).items():
                    for k, starts in cands.items():
                        if any(index.holds(texts[d][max(s - rules.run, 0) : s + rules.passage + rules.run], k) for s in starts):
                            out.append((ids.iloc[d], index.ids[k]))
                yield pd.DataFrame(out, columns=["doc_id", "item_id"], dtype=object)

    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(scan, f"doc_id {kinds[0]}, item_id {kinds[1]}").distinct()
