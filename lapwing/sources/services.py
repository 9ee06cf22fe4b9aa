"""Landed responses of bibliographic services brought to registry rows.

The services themselves are asked by an ingestion job (see fetch.py); here their
stored responses are parsed with built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.citations import tier_of_crossref, tier_of_types
from lapwing.functions.text import strip

_CROSSREF = "message struct<items:array<struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,DOI:string,URL:string,type:string,abstract:string,score:double>>>"
_S2_PAPER = "title string, authors array<struct<name:string>>, year int, venue string, abstract string, url string, externalIds struct<DOI:string,ArXiv:string>, publicationTypes array<string>"
_S2 = f"data array<struct<{_S2_PAPER.replace(' ', ':').replace(',:', ',')}>>"


def _none(kind: str):
    return F.lit(None).cast(kind)


def decoded(c):
    """Text of XML with its five named entities resolved."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def crossref(responses: DataFrame, column: str = "body") -> DataFrame:
    """Rows of JSON responses: title, authors as given and family name, first part of the date, relevance."""
    i = responses.select(F.explode(F.from_json(column, _CROSSREF)["message"]["items"]).alias("i"))
    name = F.transform(F.coalesce("i.author", F.array()), lambda a: strip(F.concat_ws(" ", a["given"], a["family"])))
    venue = F.try_element_at(F.col("i.container-title"), F.lit(1))
    year = F.try_element_at(F.try_element_at(F.col("i.issued")["date-parts"], F.lit(1)), F.lit(1))
    return i.select(F.lit("crossref").alias("source"), F.try_element_at("i.title", F.lit(1)).alias("title"), name.alias("authors"), year.alias("year"), venue.alias("venue"), F.col("i.DOI").alias("doi"), _none("string").alias("arxiv_id"), F.col("i.URL").alias("url"), F.col("i.abstract").alias("abstract"), tier_of_crossref(F.col("i.type"), venue).alias("manifestation"), F.coalesce("i.score", F.lit(0.0)).alias("score"))


def semantic_scholar(responses: DataFrame, column: str = "body") -> DataFrame:
    """Rows of JSON responses, be they lists found by a search or the single paper of a DOI lookup."""
    single = F.from_json(column, _S2_PAPER)
    found = F.coalesce(F.from_json(column, _S2)["data"], F.when(single["title"].isNotNull(), F.array(single)))
    i = responses.select(F.explode(found).alias("i"))
    ax = F.col("i.externalIds.ArXiv")
    return i.select(F.lit("semantic_scholar").alias("source"), "i.title", F.transform(F.coalesce("i.authors", F.array()), lambda a: a["name"]).alias("authors"), "i.year", "i.venue", F.col("i.externalIds.DOI").alias("doi"), ax.alias("arxiv_id"), "i.url", "i.abstract", tier_of_types(F.col("i.publicationTypes"), ax).alias("manifestation"), F.lit(0.0).alias("score"))


def arxiv(responses: DataFrame, column: str = "body") -> DataFrame:
    """Entries of Atom feeds; venue and manifestation are those of the archive."""
    e = responses.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    flat = lambda p: F.nullif(decoded(strip(F.regexp_replace(F.regexp_extract("e", p, 1), r"\s+", " "))), F.lit(""))
    ax = F.regexp_replace(F.regexp_extract("e", r"<id>[^<]*/abs/([^<]+)</id>", 1), r"v\d+$", "")
    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author>.*?<name>([^<]*)</name>"), F.lit(1)), lambda n: decoded(strip(n)))
    return e.select(F.lit("arxiv").alias("source"), flat(r"(?s)<title[^>]*>(.*?)</title>").alias("title"), names.alias("authors"), F.regexp_extract("e", r"<published>(\d{4})", 1).try_cast("int").alias("year"), F.lit("arXiv").alias("venue"), flat(r"<arxiv:doi[^>]*>([^<]*)</arxiv:doi>").alias("doi"), F.nullif(ax, F.lit("")).alias("arxiv_id"), flat(r"<id>([^<]*)</id>").alias("url"), flat(r"(?s)<summary[^>]*>(.*?)</summary>").alias("abstract"), F.lit("arxiv").alias("manifestation"), F.lit(0.0).alias("score"))


def pubmed(responses: DataFrame, column: str = "body") -> DataFrame:
    """Articles of fetched XML; the year is the first four digits of Year or MedlineDate."""
    e = responses.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<PubmedArticle\b.*?</PubmedArticle>"), F.lit(0))).alias("e"))
    flat = lambda p: F.nullif(decoded(strip(F.regexp_replace(F.regexp_extract("e", p, 1), r"<[^>]+>", ""))), F.lit(""))
    # One author at a time: a missing part must not be taken from the next.
    each = F.regexp_extract_all("e", F.lit(r"(?s)<Author\b[^>]*>.*?</Author>"), F.lit(0))
    part = lambda x, tag: F.regexp_extract(x, rf"<{tag}>([^<]*)</{tag}>", 1)
    names = F.filter(F.transform(each, lambda x: strip(F.concat_ws(" ", decoded(part(x, "ForeName")), decoded(part(x, "LastName"))))), lambda n: n != "")
    year = F.regexp_extract("e", r"(?s)<PubDate>.*?<(?:Year|MedlineDate)>\s*(\d{4})", 1).try_cast("int")
    return e.select(F.lit("pubmed").alias("source"), flat(r"(?s)<ArticleTitle>(.*?)</ArticleTitle>").alias("title"), names.alias("authors"), year.alias("year"), flat(r"(?s)<Journal>.*?<Title>([^<]*)</Title>").alias("venue"), flat(r'<ArticleId IdType="doi">([^<]*)</ArticleId>').alias("doi"), _none("string").alias("arxiv_id"), _none("string").alias("url"), flat(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>").alias("abstract"), F.lit("journal").alias("manifestation"), F.lit(0.0).alias("score"))
