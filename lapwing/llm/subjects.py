"""Subject area of each document (problem 9).

Documents become term-weighted vectors (log frequency times inverse document
frequency); a truncated singular value decomposition of the whole corpus is
found by orthogonal iteration, one pass over the documents each, in which
executors add up blocks of a (terms x rank) matrix, so what travels is bounded
by the vocabulary. Labelled documents give a seed centroid for each subject and
language; the centroids are refined by assigning all documents by cosine
similarity and averaging again. Sentences are embedded in the same space by
their telling terms - those whose own vector is much closer to a centroid of one
subject than to any other subject's - and go to the subject of the centroid of
highest cosine, if it is clearly above the next subject's. A document deals with
the subjects that at least a third of its sentences are about.

The vocabulary holds terms in at least ``min_share`` of the documents, so its
size is bounded by terms per document over ``min_share`` whatever the corpus. Of
the terms in more than ``max_share`` of the distinct texts only those are left
out that spread evenly over the subjects of the labelled texts. Defined cases: null or empty texts, and texts without a
known term, have no subject; labels of unknown subjects or documents are
ignored, letter case aside; a document labelled with several subjects seeds
none; without labels nothing is assigned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import written

_REFERENCES = re.compile(r"(?im)^[\s#*]*(?:references?|bibliography|works cited|literatur|références|bibliografía|referencias)\s*:?\s*$")
_LINE = re.compile(r"(?m)^[^\S\n]*(?:#.*|-- .*|(?:USER|ASSISTANT|SYSTEM):)")
_ASIDE = re.compile(r"<[^<>\n]{1,40}>|\([^()\n]{0,80}\d{4}[a-z]?\)|\[\d+\]")
_SENTENCE = re.compile(r"[.!?]\s|\n")
_TERM, _ASCII_TERM = re.compile(r"[^\W\d_]{3,}"), re.compile(r"[a-z]{3,}")


@dataclass(frozen=True)
class Rules:
    rank: int = 128
    passes: int = 3
    refinements: int = 3
    min_share: float = 0.0005
    min_docs: int = 4
    #: Terms in more than this share of the distinct texts are judged by their spread over the subjects.
    max_share: float = 0.08
    #: A document takes part in a refinement if its best subject's cosine is above sure and twice the next one's.
    sure: float = 0.15
    #: A term tells of a subject from the cosine `speaks` on, if it is `telling` times the next subject's; a sentence goes to one from the same cosine on, if it is `clear` times the next.
    speaks: float = 0.12
    telling: float = 3.0
    clear: float = 1.5
    #: A frequent term is uneven if one subject's labelled texts hold it `lead` times as often as the others.
    lead: float = 2.0
    #: Share of the sentences that makes a subject.
    share: float = 1 / 3
    block: int = 512
    #: Terms per document over min_share bounds the vocabulary; checked, as it goes to every executor.
    max_terms: int = 400_000


def sentences(text: str | None) -> str:
    """Terms of each sentence, one sentence a line; headings, notes, speakers, marks and the closing bibliography left out."""
    if not text:
        return ""
    found = _REFERENCES.search(text)
    text = text[: found.start()] if found else text
    gap = "\n" if "\n" in text else " "
    low = _ASIDE.sub(gap, _LINE.sub(gap, text)).lower()
    terms = (_ASCII_TERM if low.isascii() else _TERM).findall
    lines = (" ".join(terms(s)) for s in _SENTENCE.split(low))
    return "\n".join(x for x in lines if x)


def _batches(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of a column of arrays and the row of each."""
    lengths = np.fromiter(map(len, column), np.int64, len(column))
    flat = np.concatenate([*column, np.zeros(0, np.int32)]).astype(np.int64)
    return flat, np.repeat(np.arange(len(column)), lengths)


def _weighted(column: pd.Series, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of unit-length rows, sorted by row and term."""
    flat, row = _batches(column)
    pairs, counts = np.unique(row * len(idf) + flat, return_counts=True)
    row, term = np.divmod(pairs, len(idf))
    weight = idf[term] * (1 + np.log(counts))
    norm = np.sqrt(np.bincount(row, weight**2, len(column)))
    return row, term, (weight / np.maximum(norm[row], 1e-12)).astype(np.float32)


def _matrices(column: pd.Series, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A few rows at a time: the first row's number, the terms they hold, and the rows' weights of these terms."""
    for a in range(0, len(column), 256):
        part = column.iloc[a : a + 256]
        row, term, weight = _weighted(part, idf)
        own, place = np.unique(term, return_inverse=True)
        dense = np.zeros((len(part), len(own)), np.float32)
        dense[row, place] = weight
        yield a, own, dense


def _vectors(column: pd.Series, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows times basis."""
    out = np.zeros((len(column), basis.shape[1]), np.float32)
    for a, own, dense in _matrices(column, idf):
        out[a : a + len(dense)] = dense @ basis[own]
    return out


#: Parts that are added up in one group; more of them are added up in several rounds.
FAN = 64


def _summed(parts: DataFrame, shape: tuple[int, int], block: int) -> np.ndarray:
    """The sum of blocks (part INT, block INT, data BINARY) over all tasks; the driver gets one matrix."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4, np.float64)
        for x in pdf["data"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"part": [key[0]], "block": [key[1]], "data": [total.astype(np.float32).tobytes()]})

    tasks = parts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("part", "block").applyInPandas(add, "part int, block int, data binary")
    out = np.zeros(shape, np.float64)
    for r in parts.collect():
        data = np.frombuffer(r.data, np.float32).reshape(-1, shape[1])
        out[r.block * block : r.block * block + len(data)] = data
    return out


def _blocks(matrix: np.ndarray, block: int) -> pd.DataFrame:
    rows = range(0, len(matrix), block)
    return pd.DataFrame({"part": np.int32(TaskContext.get().partitionId()), "block": np.arange(len(rows), dtype=np.int32), "data": [matrix[r : r + block].astype(np.float32).tobytes() for r in rows]})


def decompose(encoded: DataFrame, idf: np.ndarray, rules: Rules) -> np.ndarray:
    """Right singular vectors (terms x rank) of all documents' weighted vectors."""
    spark = encoded.sparkSession
    rank = min(rules.rank, len(idf))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(idf), rank)))[0].astype(np.float32)
    for _ in range(rules.passes):
        shared = spark.sparkContext.broadcast((idf, basis))

        def power(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            idf, basis = shared.value
            total = np.zeros(basis.shape, np.float32)
            for b in batches:
                for _, own, dense in _matrices(b["terms"], idf):
                    total[own] += dense.T @ (dense @ basis[own])
            yield _blocks(total, rules.block)

        product = _summed(encoded.select("terms").mapInPandas(power, "part int, block int, data binary"), basis.shape, rules.block)
        basis = np.linalg.qr(product)[0].astype(np.float32)
        shared.unpersist()
    return basis


def refine(vectors: DataFrame, seeds: DataFrame, names: list[str], rules: Rules) -> tuple[list[str], np.ndarray]:
    """Owner subject and unit vector of each centroid, from vectors(doc_id, lang, vec) and seeds(doc_id, subject)."""
    spark = vectors.sparkSession

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"subject": [key[0]], "lang": [key[1]], "vec": [sum(np.frombuffer(v, np.float32).astype(np.float64) for v in pdf["vec"]).astype(np.float32).tobytes()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for b in batches:
            for s, lang, v in zip(b["subject"], b["lang"], b["vec"], strict=True):
                x = np.frombuffer(v, np.float32)
                sums[s, lang] = sums.get((s, lang), 0) + x
        yield pd.DataFrame([(s, lang, x.tobytes()) for (s, lang), x in sums.items()], columns=["subject", "lang", "vec"])

    labelled = vectors.join(seeds, "doc_id").select("subject", "lang", "vec").mapInPandas(partial, "subject string, lang string, vec binary")
    rows = labelled.groupBy("subject", "lang").applyInPandas(total, "subject string, lang string, vec binary").collect()
    rows = sorted((r for r in rows if r.subject in names), key=lambda r: (r.subject, r.lang or ""))
    owners = [r.subject for r in rows]
    if not owners:
        return [], np.zeros((0, 1), np.float32)
    centroids = unit(np.array([np.frombuffer(r.vec, np.float32) for r in rows], np.float64))
    for _ in range(rules.refinements):
        shared = spark.sparkContext.broadcast((np.array([names.index(o) for o in owners]), centroids.astype(np.float32)))

        def assign(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            owner, centre = shared.value
            sums = np.zeros(centre.shape, np.float32)
            for b in batches:
                x = np.frombuffer(b"".join(b["vec"]), np.float32).reshape(len(b), -1)
                cosine = x @ centre.T
                by = np.stack([cosine[:, owner == s].max(axis=1, initial=-1) for s in range(len(names))], axis=1)
                order = np.sort(by, axis=1)
                second = order[:, -2] if by.shape[1] > 1 else np.zeros(len(b))
                sure = (order[:, -1] > rules.sure) & (order[:, -1] > 2 * second)
                np.add.at(sums, cosine.argmax(axis=1)[sure], x[sure])
            yield _blocks(sums, rules.block)

        sums = _summed(vectors.select("vec").mapInPandas(assign, "part int, block int, data binary"), centroids.shape, rules.block)
        centroids = unit(sums + 1e-6 * centroids)
        shared.unpersist()
    return owners, centroids


def general(bodies: DataFrame, seeds: DataFrame, terms: list[str], rules: Rules) -> set[str]:
    """Those of these terms that labelled texts hold whatever their subject; each text counts once a subject."""
    if not terms:
        return set()
    held = F.array_intersect(F.split("text", r"[ \n]"), F.array(*map(F.lit, terms)))
    texts = written(bodies.select("doc_id", F.xxhash64("text").alias("digest"), held.alias("held")).join(seeds, "doc_id").dropDuplicates(["subject", "digest"]).select("subject", "held"))
    size = {r.subject: r["count"] for r in texts.groupBy("subject").count().collect()}
    seen: dict[str, dict[str, int]] = {}
    for r in texts.select("subject", F.explode("held").alias("term")).groupBy("subject", "term").count().collect():
        seen.setdefault(r.term, {})[r.subject] = r["count"]
    every, out = sum(size.values()), set()
    for term, by in seen.items():
        total = sum(by.values())
        uneven = False
        for s, x in by.items():
            own, rest = (x + 0.5) / (size[s] + 1), (total - x + 0.5) / (every - size[s] + 1)
            # Few labelled texts spread unevenly by chance.
            uneven |= own >= rules.lead * rest and own - rest > 3 * math.sqrt(rest * (1 - rest) / size[s])
        if total >= rules.min_docs and not uneven:
            out.add(term)
    return out


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(doc_id, subject, share) for documents(doc_id, text, lang), labels(doc_id, subject), subjects(subject)."""
    rules = rules or Rules()
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id bigint, subject string, share double")
    spelt = {r.subject.strip().lower(): r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect()}
    names = sorted(spelt)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"].astype(object), "text": [sentences(t) for t in b["text"]]})

    docs = documents.select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), "text").where(F.length("text") > 0)
    bodies = written(docs.mapInPandas(clean, "doc_id bigint, lang string, text string").where("text <> ''"))
    n = bodies.count()
    if not n or not names:
        return empty
    # A document labelled with one subject only, whoever said it and however often, is a seed.
    said = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names))
    seeds = said.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("other")).where("subject = other").drop("other")
    distinct = bodies.select(F.xxhash64("text")).distinct().count()
    texts = bodies.groupBy("text").agg(F.count("*").alias("copies"))
    counted = texts.select("copies", F.explode(F.array_distinct(F.split("text", r"[ \n]"))).alias("term")).groupBy("term").agg(F.sum("copies").alias("docs"), F.count("*").alias("texts"))
    kept = counted.where(F.col("docs") >= max(rules.min_docs, rules.min_share * n)).limit(rules.max_terms + 1).collect()
    if len(kept) > rules.max_terms:
        raise ValueError(f"more than {rules.max_terms} terms in {rules.min_share:.2%} of the documents: raise Rules.max_terms once the basis is known to fit the executors")
    left_out = general(bodies, seeds, sorted(r.term for r in kept if r.texts > max(rules.max_share * distinct, rules.min_docs)), rules)
    kept = sorted((r for r in kept if r.term not in left_out), key=lambda r: r.term)
    if not kept:
        return empty
    idf = np.array([math.log(max(distinct / r.texts, 1)) + 1e-3 for r in kept], np.float32)
    lexicon = spark.sparkContext.broadcast({r.term: i for i, r in enumerate(kept)})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = lexicon.value.get
        for b in batches:
            terms, sizes = [], []
            for text in b["text"]:
                ids, size = [], []
                for line in text.split("\n"):
                    own = [i for i in map(get, line.split(" ")) if i is not None]
                    ids += own
                    size.append(len(own))
                terms.append(np.array(ids, np.int32))
                sizes.append(np.array(size, np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"].astype(object), "terms": terms, "sizes": sizes})

    encoded = written(bodies.mapInPandas(encode, "doc_id bigint, lang string, terms array<int>, sizes array<int>"))
    basis = decompose(encoded, idf, rules)
    space = spark.sparkContext.broadcast((idf, basis))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = space.value
        for b in batches:
            x = _vectors(b["terms"], idf, basis)
            x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"].astype(object), "vec": [v.tobytes() for v in x]})

    vectors = written(encoded.mapInPandas(embed, "doc_id bigint, lang string, vec binary"))
    owners, centroids = refine(vectors, seeds, names, rules)
    if not owners:
        return empty
    term_vectors = basis * idf[:, None]
    term_vectors = term_vectors / np.maximum(np.linalg.norm(term_vectors, axis=1), 1e-12)[:, None]
    cosine = term_vectors @ centroids.T
    owner = np.array([names.index(o) for o in owners])
    by = np.stack([cosine[:, owner == s].max(axis=1, initial=0) for s in range(len(names))], axis=1)
    order = np.sort(by, axis=1)
    second = order[:, -2] if by.shape[1] > 1 else 0
    tells = (order[:, -1] > rules.speaks) & (order[:, -1] > rules.telling * second)
    # What a term adds to its sentence's vector; terms that tell of no subject add nothing.
    place = np.where(tells, np.cumsum(tells) - 1, -1)
    table = spark.sparkContext.broadcast((place, (basis * idf[:, None])[tells].astype(np.float32), centroids.astype(np.float32), owner, [spelt[x] for x in names]))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, adds, centroids, owner, spelt = table.value
        for b in batches:
            terms, _ = _batches(b["terms"])
            sizes, row = _batches(b["sizes"])
            told = place[terms]
            sentence = np.repeat(np.arange(len(sizes)), sizes)[told >= 0]
            told = told[told >= 0]
            starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(told) else np.zeros(0, np.int64)
            best = np.full(len(sizes), -1)
            for a in range(0, len(starts), 4096):
                own = starts[a : a + 4096]
                end = starts[a + 4096] if a + 4096 < len(starts) else len(told)
                x = np.add.reduceat(adds[told[own[0] : end]], own - own[0], axis=0)
                cosine = x @ centroids.T / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                by = np.stack([cosine[:, owner == s].max(axis=1, initial=-1) for s in range(len(spelt))], axis=1)
                order = np.sort(by, axis=1)
                second = order[:, -2] if len(spelt) > 1 else 0
                best[sentence[own]] = np.where((order[:, -1] > rules.speaks) & (order[:, -1] > rules.clear * second), by.argmax(axis=1), -1)
            total = np.bincount(row, minlength=len(b))
            for s, name in enumerate(spelt):
                part = np.bincount(row[best == s], minlength=len(b)) / np.maximum(total, 1)
                hit = part >= rules.share - 1e-9
                yield pd.DataFrame({"doc_id": b["doc_id"][hit], "subject": name, "share": part[hit]})

    return encoded.select("doc_id", "terms", "sizes").mapInPandas(shares, "doc_id bigint, subject string, share double")
