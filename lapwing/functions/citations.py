"""Citation patterns and the parsing of bibliography entries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapwing.functions.text import marked, strip, text

# Patterns of identifiers and markers. Groups are numbered from 2 where a pattern is used with marked().
DOI = r"(?i)\b10\.\d{4,9}/[^\s,;)\]\"']+"
ARXIV = r"(?i)\barXiv:\s*(\d{4}\.\d{4,5})(v\d+)?"
URL = r"https?://\S+"
NAME = r"[A-Z][A-Za-z\-']+(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][A-Za-z\-']+)?"
PARENTHETICAL = rf"\({NAME},\s*\d{{4}}[a-z]?\)"
NARRATIVE = rf"\b{NAME}\s+\(\d{{4}}[a-z]?\)"
NUMERIC = r"\[\d+(?:\s*[,\-]\s*\d+)*\]"
HEADER = r"(?im)^\s*(?:#+\s*)?(?:references|bibliography|works\s+cited)\s*$"
ENTRY_BREAK = r"\n(?=\s*(?:\[\d+\]|\d+\.\s|[A-Z][a-z]+,\s))"
LEADING_NUMBER = r"^\s*(?:\[\d+\]|\d+\.)\s*"
YEAR_IN_PARENTHESES = r"\(((?:19|20|21)\d{2}[a-z]?)\)"
BARE_YEAR = r"\b((?:19|20|21)\d{2}[a-z]?)\b"
AUTHOR_SEPARATOR = r"\s*,\s*&\s*|\s*;\s*|\s*,\s+and\s+|\s+&\s+|\s+and\s+|\s*,\s*"
MAX_AUTHORS = 8


def first(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, null if none."""
    return F.nullif(F.regexp_extract(text(c), pattern, group), F.lit(""))


def every(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def spans(c: Column | str, pattern: str) -> Column:
    """Array of (raw, span_start, span_end) of all matches, in code points."""
    parts = marked(text(c), pattern)
    kind = "array<struct<raw:string,span_start:int,span_end:int>>"
    folded = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(kind).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(p.alias("raw"), acc["at"].alias("span_start"), (acc["at"] + F.length(p)).alias("span_end"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return folded["out"]


def year_of(c: Column) -> Column:
    """First four digits of a year with or without a letter."""
    return F.left(c, F.lit(4)).cast("int")


def split_authors(c: Column) -> Column:
    """Names of an author block; pieces that are initials join the name before them, eight at most."""
    pieces = F.filter(F.split(text(c), AUTHOR_SEPARATOR), lambda p: strip(p) != "")
    pieces = F.transform(pieces, lambda p: F.rtrim(strip(p), F.lit(".,")))
    bare = lambda p: strip(F.replace(p, F.lit("."), F.lit("")))
    merged = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            bare(p).rlike("^[A-Z]{1,4}$") & (F.size(acc) > 0),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(strip(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), p)))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.slice(F.filter(F.transform(merged, strip), lambda p: p != ""), 1, MAX_AUTHORS)


def trim_set(c: Column, characters: str, left: bool = True, right: bool = True) -> Column:
    if right:
        c = F.rtrim(c, F.lit(characters))
    return F.ltrim(c, F.lit(characters)) if left else c


def reference_entries(c: Column | str) -> Column:
    """Entries behind the first line that heads a bibliography; an empty array without one."""
    parts = F.split(text(c), HEADER, 2)
    own = F.filter(F.transform(F.split(F.try_element_at(parts, F.lit(2)), ENTRY_BREAK), strip), lambda x: x != "")
    return F.coalesce(own, F.array().cast("array<string>"))


def parse_reference(c: Column) -> Column:
    """Title, authors, year, venue and identifiers of one entry."""
    raw = strip(text(c))
    body = F.regexp_replace(raw, LEADING_NUMBER, "")
    in_parens = first(body, YEAR_IN_PARENTHESES, 1)
    around = F.split(body, r"\((?:19|20|21)\d{2}[a-z]?\)", 2)
    head = F.rtrim(strip(F.try_element_at(around, F.lit(1))), F.lit(",."))
    tail = strip(F.ltrim(strip(F.coalesce(F.try_element_at(around, F.lit(2)), F.lit(""))), F.lit(".:,")))
    rest = F.transform(F.filter(F.split(tail, r"\.\s+"), lambda p: strip(p) != ""), lambda p: trim_set(p, " .,"))
    venue = F.try_element_at(rest, F.lit(2))
    pieces = F.filter(F.transform(F.split(body, r"\."), strip), lambda p: p != "")
    paren = in_parens.isNotNull()
    return F.struct(
        raw.alias("raw"),
        F.nullif(F.when(paren, F.try_element_at(rest, F.lit(1))).otherwise(trim_set(F.try_element_at(pieces, F.lit(2)), " .,")), F.lit("")).alias("title"),
        split_authors(F.when(paren, head).otherwise(F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit("")))).alias("authors"),
        year_of(F.coalesce(in_parens, first(body, BARE_YEAR, 1))).alias("year"),
        F.when(paren, F.when(~F.lower(venue).rlike("^(doi|arxiv|https://|http://)"), venue)).otherwise(F.nullif(trim_set(F.try_element_at(pieces, F.lit(3)), " .,"), F.lit(""))).alias("venue"),
        first(raw, DOI).alias("doi"),
        first(raw, ARXIV, 1).alias("arxiv_id"),
        first(raw, URL).alias("url"),
    )


def tier_of_citation(arxiv_id: Column, venue: Column) -> Column:
    """Manifestation that a citation's own fields suggest."""
    v = F.lower(text(venue))
    return (
        F.when((text(arxiv_id) != "") | v.contains("arxiv"), "arxiv")
        .when(v.rlike("journal|transactions|letters"), "journal")
        .when(v.rlike("proceedings|conference|workshop|symposium"), "conference")
        .otherwise("unknown")
    )


def tier_of_crossref(kind: Column, venue: Column) -> Column:
    """Manifestation of a type of the first source's records."""
    k, v = F.lower(text(kind)), F.lower(text(venue))
    return F.when(k.contains("journal-article"), "journal").when(k.rlike("proceedings|conference"), "conference").when(k.contains("posted-content") & ~v.contains("arxiv"), "preprint").when(k.contains("posted-content") | v.contains("arxiv"), "arxiv").otherwise("unknown")


def tier_of_types(types: Column, arxiv_id: Column) -> Column:
    """Manifestation of a list of publication types."""
    t = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    preprint = F.exists(t, lambda x: x.rlike("review|preprint")) | (text(arxiv_id) != "")
    return F.when(F.array_contains(t, "journalarticle"), "journal").when(F.array_contains(t, "conference"), "conference").when(preprint, F.when(text(arxiv_id) != "", "arxiv").otherwise("preprint")).otherwise("unknown")


def stable_key(doi: Column, arxiv_id: Column, title: Column, raw: Column) -> Column:
    """What two mentions of one citation share."""
    return (
        F.when(text(doi) != "", F.concat(F.lit("doi::"), F.lower(doi)))
        .when(text(arxiv_id) != "", F.concat(F.lit("arxiv::"), F.lower(arxiv_id)))
        .when(text(title) != "", F.concat(F.lit("title::"), F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")))
        .otherwise(F.concat(F.lit("raw::"), text(raw)))
    )


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40)), F.lit("")), F.lit("ref"))


def normalised_url(c: Column) -> Column:
    """A bare DOI becomes its resolver's address, anything else is only trimmed."""
    own = strip(c)
    return F.when(own.rlike(r"(?i)^10\.\d{4,9}/[^\s,;)\]\"']+$"), F.concat(F.lit("https://doi.org/"), own)).otherwise(own)
