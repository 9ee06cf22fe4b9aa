"""Matching entities across sources without keys (problem 2), and the groups of records of one work that problem 4 fuses.

Titles are brought to a comparable form and compared once per distinct form.
Sorted neighbourhood: the forms are sorted by several composite keys (title as
it stands, rare words before common ones, words from the end, authors and year), the sort is
range-partitioned, and a window slides over it, also across partition
borders. A bit signature of the words drops hopeless pairs in bulk, the others
get weighted similarities of title, authors and year. Registry records become
works through shared identifiers, equal forms and such pairs. Entries without
identifiers are then assigned to works: each cited form (title, authors and year
as written) takes the one work of highest confidence, and with it all records of
that work. Several forms may cite one work, so works are not used up.

Defined cases: null or blank titles take no part; missing authors or years
neither speak for nor against a match; repeated rows count once.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import INVISIBLE, LOOKALIKES, components, partitions, written
from lapwing.llm.names import osa

WINDOW = 10
#: Titles of fewer words may be cut off or general, so authors have to confirm them.
WHOLE_WORDS = 6
WEIGHTS = {"title": 0.6, "authors": 0.25, "year": 0.15}
THRESHOLD = 0.6

_ORDINALS = {"second": "2", "third": "3", "fourth": "4", "fifth": "5"}
_NUMERALS = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "two": "2", "three": "3", "four": "4", "five": "5", "2": "2", "3": "3", "4": "4", "5": "5"}
_PART_WORDS = ("part", "teil", "partie", "parte", "volume")
_REPORT_WORDS = ("report", "part", "paper", "study", "note", "series", "edition")


def _tables() -> tuple[str, str]:
    """Characters with a one-letter plain form, and those forms."""
    # Small letters only, as all text is lower-cased first; a capital's look-alike passes to its small letter, unless that has its own.
    plain = {a: b for a, b in LOOKALIKES.items() if a.islower()}
    for a, b in LOOKALIKES.items():
        plain.setdefault(a.lower(), b.lower())
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x400, 0x530), *range(0xFF01, 0xFF5F)]:
        c = chr(n)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c == c.lower():
            plain.setdefault(c, plain.get(base, base).lower())
    plain |= {"ø": "o", "ł": "l", "đ": "d", "ı": "i"}
    # Characters to delete stand at the end, without a counterpart.
    return "".join(plain) + INVISIBLE + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


_FROM, _TO = _tables()


_BEYOND_ASCII = r"[^\x00-\x7F]"


def plain(c: Column) -> Column:
    """Lower case without accents, look-alikes and invisible characters."""
    c = F.translate(F.lower(c), _FROM, _TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title_form(c: Column) -> Column:
    """Words of a title, one blank between them; null if there are none."""
    # Most titles are ASCII, for which the short way gives the same.
    form = F.when(c.rlike(_BEYOND_ASCII), F.regexp_replace(plain(c), r"[^\p{L}\p{N}]+", " ")).otherwise(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.nullif(F.trim(form), F.lit(""))


def author_words(c: Column) -> Column:
    """Distinct longer words of an author list in alphabetical order."""
    every = F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    words = F.when(every.rlike(_BEYOND_ASCII), F.split(plain(every), r"[^\p{L}]+")).otherwise(F.split(F.lower(every), "[^a-z]+"))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))), " ")


def doi_form(c: Column) -> Column:
    low = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.nullif(F.regexp_replace(F.regexp_extract(low, r"(10\..*)$", 1), r"[.,;)\]]+$", ""), F.lit(""))


def arxiv_form(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^arxiv\s*:\s*", ""), r"v\d+$", ""), F.lit(""))


def year_form(c: Column) -> Column:
    """A year of four digits, 0 if missing."""
    return F.coalesce(F.when(c.between(1000, 2999), c.cast("int")), F.lit(0))


@lru_cache(maxsize=1 << 16)
def part_of(form: str) -> tuple[str, str]:
    """Title without its part number, and that number ('' if none)."""
    words = form.split()
    if len(words) < 3:
        return form, ""
    last, before = words[-1], words[-2]
    if last in _NUMERALS:
        if any(osa(before, w, 1) <= 1 for w in _PART_WORDS):
            return " ".join(words[:-2]), _NUMERALS[last]
        if last in ("ii", "iii", "iv", "v"):
            return " ".join(words[:-1]), _NUMERALS[last]
    elif len(before) > 4 and any(osa(last, w, 1) <= 1 for w in _REPORT_WORDS):
        ordinal = next((n for w, n in _ORDINALS.items() if osa(before, w, 1) <= 1), "")
        if ordinal:
            return " ".join(words[:-2]), ordinal
    return form, ""


def _typos(a: list[str], b: list[str]) -> int | None:
    """Misspelt words between two lists of one length; None if some words are different ones. A misspelt word keeps its first or its last letter."""
    wrong = 0
    for x, y in zip(a, b, strict=True):
        if x != y:
            if x[0] != y[0] and x[-1] != y[-1] or x.isdigit() or y.isdigit() or osa(x, y, 2) > (1 if max(len(x), len(y)) < 8 else 2):
                return None
            wrong += 1
    return wrong if wrong <= max(1, (len(a) + 1) // 3) else None


def title_similarity(a: str, b: str) -> tuple[float, str]:
    """Similarity and kind: 'same', 'typo', 'order' (parts of the title swapped), 'cut' (one is the other's beginning), '' (another title)."""
    if a == b:
        return 1.0, "same"
    (base_a, part_a), (base_b, part_b) = part_of(a), part_of(b)
    x, y = base_a.split(), base_b.split()
    if len(x) > len(y):
        x, y, part_a, part_b = y, x, part_b, part_a
    if part_a == part_b:
        if len(x) == len(y):
            wrong = _typos(x, y)
            if wrong is not None:
                return 1 - 0.1 * wrong / len(x), "typo"
            # Two words out of place can't be parts of the title that changed places.
            moved = sum(v != w for v, w in zip(x, y, strict=True)) > 2
            wrong = _typos(sorted(x), sorted(y)) if moved else None
            if wrong is not None and len(set(x) & set(y)) >= len(set(x)) - wrong:
                return 0.95 - 0.1 * wrong / len(x), "order"
        elif len(y) - len(x) <= 2 and osa("".join(x), "".join(y), 2) <= 2:
            return 0.9, "typo"
    if len(x) < len(y) and not part_a:
        head = y[: len(x)]
        wrong = _typos(x[:-1], head[:-1]) if len(x) > 1 else 0
        if wrong is not None and wrong <= 1 and (osa(x[-1], head[-1], 1) <= 1 or len(x) > 1 and len(x[-1]) > 2 and head[-1].startswith(x[-1])):
            return 0.55 + 0.35 * len(x) / len(y), "cut"
    return 0.0, ""


def author_similarity(a: str, b: str) -> float | None:
    """Share of the shorter list's words found in the other, misspelt or not; None if one is missing."""
    x, y = a.split(), b.split()
    if not x or not y:
        return None
    if len(x) > len(y):
        x, y = y, x
    own = set(y)
    return sum(w in own or len(w) > 4 and any(osa(w, v, 1) <= 1 for v in y if v[0] == w[0] or v[-1] == w[-1]) for w in x) / len(x)


def year_similarity(low_a: int, high_a: int, low_b: int, high_b: int) -> float | None:
    """1 if the spans of years meet, 0.7 a year apart, 0.3 two years, else 0; None if one is missing (0)."""
    if not low_a or not low_b:
        return None
    gap = max(low_a - high_b, low_b - high_a, 0)
    return {0: 1.0, 1: 0.7, 2: 0.3}.get(gap, 0.0)


def confidence(a: tuple, b: tuple) -> float:
    """Weighted similarity of two (form, authors, low year, high year); 0 if they are different works."""
    title, kind = title_similarity(a[0], b[0])
    if not kind:
        return 0.0
    authors, year = author_similarity(a[1], b[1]), year_similarity(*a[2:], *b[2:])
    if kind == "cut" or min(len(a[0].split()), len(b[0].split())) < WHOLE_WORDS:
        if authors is None or authors < 0.5 or year is not None and year < 0.3:
            return 0.0
    elif authors is not None and authors < 0.3 and year is not None and year < 0.3:
        return 0.0
    parts = [("title", title), ("authors", 0.5 if authors is None else authors), ("year", 0.5 if year is None else year)]
    return sum(WEIGHTS[k] * v for k, v in parts)


_COLUMNS = ["side", "form", "authors", "low", "high"]


def _signatures(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each form in two words of 64, and the number of words."""
    out = np.zeros((len(forms), 2), np.uint64)
    seen: dict[str, tuple[int, np.uint64]] = {}
    size = np.zeros(len(forms), np.int64)
    for k, form in enumerate(forms):
        words = form.split(" ")
        size[k] = len(words)
        for w in words:
            bit = seen.get(w)
            if bit is None:
                h = zlib.crc32(w.encode())
                bit = seen[w] = (h & 1, np.uint64(1) << np.uint64(h >> 1 & 63))
            out[k, bit[0]] |= bit[1]
    return out, size


def _window_pairs(rows: pd.DataFrame, first: int, cross: bool) -> list[tuple]:
    """Confident pairs of rows of one sort key within the window, whose later row is `first` or behind; cross: entries against records only, by title alone.

    Rows with a column `pos` stand that far apart, and those of one `part` have met.
    """
    n = len(rows)
    forms, authors = rows["form"].tolist(), rows["authors"].tolist()
    low, high = rows["low"].tolist(), rows["high"].tolist()
    side, sort = rows["side"].to_numpy(), rows["sort"].to_numpy()
    bits, words = _signatures(forms)
    size = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    out = []
    for d in range(1, min(WINDOW, n - 1) + 1):
        both = np.bitwise_count(bits[:-d] & bits[d:]).sum(axis=1).astype(np.int64)
        less, more = np.minimum(size[:-d], size[d:]), np.maximum(size[:-d], size[d:])
        # Whole titles differ in two words at most, misspelt both of them; a cut one has all words but one in the other.
        ok = np.where(np.abs(words[:-d] - words[d:]) <= 2, both >= more - 2, both >= less - 1)
        ok &= sort[:-d] == sort[d:]
        if cross:
            ok &= side[:-d] != side[d:]
        ok[: max(first - d, 0)] = False
        if "pos" in rows:
            pos, part = rows["pos"].to_numpy(), rows["part"].to_numpy()
            ok &= (pos[d:] - pos[:-d] <= WINDOW) & (part[:-d] != part[d:])
        for i in np.flatnonzero(ok).tolist():
            a, b = (i, i + d) if side[i] <= side[i + d] else (i + d, i)
            if cross:
                # Authors and years are compared later, as a form may come with several.
                c = title_similarity(forms[a], forms[b])[0]
            else:
                c = confidence((forms[a], authors[a], low[a], high[a]), (forms[b], authors[b], low[b], high[b])) if forms[a] != forms[b] else 0.0
            if c >= THRESHOLD or cross and c:
                out.append((forms[a], forms[b]))
    return out


_PAIRS = "form_a string, form_b string"
_PAIR_COLUMNS = ["form_a", "form_b"]


def sorted_neighbourhood(forms: DataFrame, cross: bool, common_share: float = 0.001, rows_apart: int = 40 * WINDOW) -> DataFrame:
    """(form_a, form_b) of the confident pairs among forms(side, form, authors, low, high), one row per side and form.

    cross: pairs of side 0 (entries) with side 1 (records) only, by their titles. Words in more
    than common_share of the forms - by that share a few thousand at most - come
    behind the others in the second sort key. A partition holds rows_apart rows or
    more on average.
    """
    spark = forms.sparkSession
    rows = written(forms.select(*_COLUMNS))
    total = rows.count()
    listed = rows.select(F.explode(F.split("form", " ")).alias("word")).groupBy("word").count()
    common = spark.sparkContext.broadcast(frozenset(r.word for r in listed.where(F.col("count") > common_share * total + 3).select("word").collect()))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = common.value
        for b in batches:
            keys: list[list[str]] = [[], [], [], []]
            for form, authors, low in zip(b["form"], b["authors"], b["low"], strict=True):
                words = form.split(" ")
                keys[0].append(" ".join([*[w for w in words if w not in frequent], "\t", *[w for w in words if w in frequent]]))
                keys[1].append(" ".join(words[::-1]))
                keys[3].append(form)
                keys[2].append(f"{authors}\t{low}\t{form}" if authors else "")
            for sort, own in enumerate(keys):
                out = b.assign(sort=np.int32(sort), key=own)
                yield out[out["key"] != ""] if sort == 2 else out

    sides = "side int, form string, authors string, low int, high int, sort int"
    n = max(1, min(partitions(spark), 4 * total // rows_apart))
    # All columns order the rows, so that the neighbours are the same however many partitions there are.
    placed = rows.mapInPandas(keyed, sides + ", key string").repartitionByRange(n, "sort", "key").sortWithinPartitions("sort", "key", "side", "form", "authors", "low", "high").drop("key")
    columns = [*_COLUMNS, "sort"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        head: pd.DataFrame | None = None
        tail: pd.DataFrame | None = None

        def out(frame: pd.DataFrame, **fixed) -> pd.DataFrame:
            frame = frame.assign(**fixed)
            return pd.DataFrame({c: frame[c].astype(object) if c in frame else None for c in ["part", "at", "size", *columns, *_PAIR_COLUMNS]})

        for b in batches:
            if not len(b):
                continue
            b = b.assign(at=np.arange(seen, seen + len(b)))
            seen += len(b)
            head = b.head(WINDOW) if head is None else pd.concat([head, b.head(WINDOW - len(head))], ignore_index=True) if len(head) < WINDOW else head
            rows = b if tail is None else pd.concat([tail, b], ignore_index=True)
            pairs = _window_pairs(rows, 0 if tail is None else len(tail), cross)
            if pairs:
                yield out(pd.DataFrame(pairs, columns=_PAIR_COLUMNS), part=-1)
            tail = rows.tail(WINDOW).reset_index(drop=True)
        if head is not None:
            yield out(pd.concat([head, tail]).drop_duplicates("at"), part=part, size=seen)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        # The first and last rows of all partitions, at most 2 * WINDOW of each, at their places in the whole order.
        pdf = pdf.sort_values(["part", "at"], kind="stable").reset_index(drop=True)
        sizes = pdf.groupby("part")["size"].first()
        pdf["pos"] = pdf["part"].map(sizes.cumsum() - sizes) + pdf["at"]
        return pd.DataFrame(_window_pairs(pdf, 0, cross), columns=_PAIR_COLUMNS)

    found = written(placed.mapInPandas(scan, f"part int, at long, size long, {sides}, {_PAIRS}"))
    pairs = found.where("part = -1").select(*_PAIR_COLUMNS)
    if n > 1:
        pairs = pairs.unionByName(found.where("part >= 0").select(F.lit(0).alias("every"), "part", "at", "size", *columns).groupBy("every").applyInPandas(meet, _PAIRS))
    return pairs.distinct()


#: Titles of more distinct words meet within the windows only: left-out words of all pairs of words would be too many keys.
LEFT_OUT_WORDS = 24


def left_out_pairs(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(form, form_b) of entries(form) and records(form) that have the same words, wherever they stand, once one or two are left out of each; of two the record's rarest word is none.

    Each form brings digests of its words less none, one or two, so only forms
    that are nearly alike meet, and their number follows that of the forms;
    equal digests of different words bring a needless pair at most.
    """

    def numbered(forms: DataFrame) -> DataFrame:
        own = forms.select("form", F.monotonically_increasing_id().alias("id"), F.expr("array_sort(transform(array_distinct(split(form, ' ')), x -> xxhash64(x)))").alias("w"))
        return written(own.where(F.size("w").between(3, LEFT_OUT_WORDS)))

    left, right = numbered(entries), numbered(records)
    each = right.select("id", F.explode("w").alias("word"))
    uses = each.groupBy("word").agg(F.count("*").alias("uses"))
    rarest = each.join(uses, "word").groupBy("id").agg(F.array_sort(F.collect_list("word")).alias("w"), F.min_by("word", F.struct("uses", "word")).alias("kept"))

    def keys(own: DataFrame, kept: str) -> DataFrame:
        one = "transform(w, a -> xxhash64(filter(w, x -> x <> a)))"
        two = f"flatten(transform({kept}, a -> transform(filter({kept}, b -> b > a), b -> xxhash64(filter(w, x -> x <> a AND x <> b)))))"
        return own.select("id", F.explode(F.array_distinct(F.expr(f"concat(array(xxhash64(w)), {one}, {two})"))).alias("key"))

    met = keys(left, "w").join(keys(rarest, "filter(w, k -> k <> kept)").withColumnRenamed("id", "id_b"), "key").select("id", "id_b").distinct()
    return met.join(left.select("id", "form"), "id").join(right.select(F.col("id").alias("id_b"), F.col("form").alias("form_b")), "id_b").select("form", "form_b")


def comparable(df: DataFrame, id_col: str) -> DataFrame:
    """(id, form, authors, year) of rows; form is null without a title."""
    return df.select(F.col(id_col).alias("id"), title_form(F.col("title")).alias("form"), author_words(F.col("authors")).alias("authors"), year_form(F.col("year")).alias("year"))


def _spans(rows: DataFrame, side: int) -> DataFrame:
    """One row per form: its longest author list and its span of years."""
    real = F.when(F.col("year") > 0, F.col("year"))
    return rows.groupBy("form").agg(F.max_by("authors", F.struct(F.length("authors"), "authors")).alias("authors"), F.coalesce(F.min(real), F.lit(0)).alias("low"), F.coalesce(F.max(real), F.lit(0)).alias("high")).select(F.lit(side).alias("side"), "form", "authors", "low", "high")


def works(registry: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """(record_id, form, authors, year, doi, work) and the columns to keep: records of one work share `work`; repeated rows stay."""
    keep = keep or {}
    # A short title names a work only together with its authors.
    short = F.size(F.split("form", " ")) < WHOLE_WORDS
    own = registry.select("record_id", title_form(F.col("title")).alias("form"), author_words(F.col("authors")).alias("authors"), year_form(F.col("year")).alias("year"), doi_form(F.col("doi")).alias("doi"), arxiv_form(F.col("arxiv_id")).alias("arxiv"), *[c.alias(k) for k, c in keep.items()])
    # Written before anything refers to the forms, or each reference would compute them again.
    rows = written(own).where("form is not null").withColumn("t", F.xxhash64("form", F.when(short, F.col("authors")).otherwise(F.lit(""))))
    pairs = sorted_neighbourhood(_spans(rows, 1), cross=False)
    by_form = rows.select("form", "t").distinct()
    close = pairs.select("form_a", "form_b").join(by_form.withColumnsRenamed({"form": "form_a", "t": "a"}), "form_a").join(by_form.withColumnsRenamed({"form": "form_b", "t": "b"}), "form_b").select("a", "b")
    # What shares an identifier, or a short title and an author's name, is tied to the smallest title key of its kind: a star, never all pairs.
    edges = close
    for key in ("doi", "arxiv"):
        held = rows.where(F.col(key).isNotNull()).select(key, F.col("t").alias("b")).distinct()
        edges = edges.unionByName(held.join(held.groupBy(key).agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), key).select("a", "b"))
    named = rows.where(short).select("form", F.col("t").alias("b"), F.explode(F.split("authors", " ")).alias("name")).where("length(name) >= 5").distinct()
    edges = edges.unionByName(named.join(named.groupBy("form", "name").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), ["form", "name"]).select("a", "b"))
    roots = components(edges)
    return rows.join(roots.withColumnRenamed("v", "t"), "t", "left").select("record_id", "form", "authors", "year", "doi", *keep, F.coalesce("root", "t").alias("work"))


def matches(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """(citation_id, record_id, confidence) of entries with a title and without identifiers, and all records of the work they cite."""
    records = written(works(registry))
    bare = citations.where((F.trim(F.coalesce("doi", F.lit(""))) == "") & (F.trim(F.coalesce("arxiv_id", F.lit(""))) == ""))
    entries = written(comparable(bare, "citation_id")).where("form is not null").distinct()
    nodes = entries.select("form", "authors", "year").distinct()
    real = F.when(F.col("year") > 0, F.col("year"))
    held = written(
        records.groupBy("form", "work").agg(F.max_by("authors", F.struct(F.length("authors"), "authors")).alias("authors_b"), F.coalesce(F.min(real), F.lit(0)).alias("low"), F.coalesce(F.max(real), F.lit(0)).alias("high"))
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["confidence"] = [confidence((f, a, y, y), (g, c, lo, hi)) for f, a, y, g, c, lo, hi in zip(b["form"], b["authors"], b["year"], b["form_b"], b["authors_b"], b["low"], b["high"], strict=True)]
            b = b[b["confidence"] >= THRESHOLD]
            if len(b):
                yield b[["form", "authors", "year", "work", "confidence"]]

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[bool(title_similarity(f, g)[1]) for f, g in zip(b["form"], b["form_b"], strict=True)]]

    # Equal forms need no window: a hot title has as many entries as it likes, but one row per work on the other side.
    scored = "form string, authors string, year int, work bigint, confidence double"
    equal = written(nodes.join(held, "form").withColumn("form_b", F.col("form")).mapInPandas(score, scored))
    rest = nodes.join(equal.select("form", "authors", "year").distinct(), ["form", "authors", "year"], "left_anti")
    # One row per form on either side: however many authors and years a form comes with, it takes one place in the window.
    pairs = sorted_neighbourhood(_spans(rest, 0).unionByName(_spans(records, 1)), cross=True)
    # However many forms lie between an entry's and the record's, the words they share bring them together; every variant of an entry's form meets what any of them met.
    forms = written(rest.select("form").distinct())
    shared = left_out_pairs(forms, held.select("form").distinct()).mapInPandas(alike, "form string, form_b string")
    met = pairs.select(F.col("form_a").alias("form"), "form_b").unionByName(shared).distinct()
    near = met.join(rest, "form").join(held.withColumnRenamed("form", "form_b"), "form_b").mapInPandas(score, scored)
    every = equal.unionByName(near)
    best = every.groupBy("form", "authors", "year").agg(F.max_by(F.struct("work", "confidence"), F.struct("confidence", "work")).alias("best")).select("form", "authors", "year", "best.*")
    cited = entries.join(best, ["form", "authors", "year"]).select(F.col("id").alias("citation_id"), "work", "confidence")
    return cited.join(records.select("record_id", "work").distinct(), "work").select("citation_id", "record_id", "confidence")
