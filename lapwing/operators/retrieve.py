"""Layer 3: candidates for each citation from the registry, their order, judgment and the state of their addresses.

What an outside search would return cannot be had offline. Candidates come from
equi-joins on blocking keys instead: DOI, arXiv id and the words of the title in
a first pass, first surname with year in a second one for what the first left
without a titled record; of each source the best five by lexical score are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.citations import normalised_url
from lapwing.functions.text import jaccard, strip, text, token_set
from lapwing.params import Params

RECORD = ["record_id", "source", "title", "authors", "year", "venue", "doi", "arxiv_id", "url", "manifestation", "score"]


def known_sources(registry: DataFrame, p: Params) -> DataFrame:
    """Records of enabled sources, once each, with the rank of their source."""
    rank = F.array_position(F.array(*[F.lit(s) for s in p.sources]), F.col("source")).cast("int")
    return registry.where(F.col("source").isin(*p.sources)).select(*RECORD).dropDuplicates(["record_id"]).withColumn("source_rank", rank)


def surname(c: Column) -> Column:
    """Last word of a name, lower case."""
    return F.lower(F.try_element_at(F.split(strip(c), r"\s+"), F.lit(-1)))


def title_key(c: Column | str) -> Column:
    """The distinct words of a title in alphabetical order; a title that is not plain ASCII as it stands, in lower case."""
    words = F.array_join(F.array_sort(token_set(c, 2, False)), " ")
    return F.nullif(F.when(text(c).rlike(r"[^\x00-\x7F]") | (words == ""), F.lower(strip(text(c)))).otherwise(words), F.lit(""))


def _keys(authors: Column, relaxed: bool = False) -> Column:
    by_author = F.when((F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0) & (F.coalesce(F.col("year"), F.lit(0)) > 0), F.concat(F.lit("a:"), surname(F.try_element_at(authors, F.lit(1))), F.lit(":"), F.col("year").cast("string")))
    if relaxed:
        return F.array_compact(F.array(by_author))
    named = [F.when(text(c) != "", F.concat(F.lit(f"{k}:"), F.lower(strip(F.col(c))))) for k, c in (("d", "doi"), ("x", "arxiv_id"))]
    return F.array_compact(F.array(*named, F.concat(F.lit("t:"), title_key("title"))))


def lexical_score(cites: DataFrame) -> Column:
    """Jaccard of the citation's title, authors and year with the record's title, not below the record's own score."""
    query = F.concat_ws(" ", text("c_title"), F.array_join(F.coalesce("c_authors", F.array().cast("array<string>")), " "), F.coalesce(F.col("c_year").cast("string"), F.lit("")))
    return F.greatest(F.coalesce("score", F.lit(0.0)), jaccard(token_set(query), token_set("title")))


def _pass(cites: DataFrame, records: DataFrame, p: Params, relaxed: bool) -> DataFrame:
    left = cites.select("citation_id", *[F.col(c).alias(f"c_{c}") for c in ("title", "authors", "year")], F.explode(_keys(F.col("authors"), relaxed)).alias("key"))
    right = records.select("*", F.explode(_keys(F.col("authors"), relaxed)).alias("key"))
    pairs = left.join(right, "key").drop("key").dropDuplicates(["citation_id", "record_id"])
    ranked = pairs.withColumn("lexical", lexical_score(pairs))
    place = F.row_number().over(Window.partitionBy("citation_id", "source_rank").orderBy(F.desc("lexical"), "record_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= p.per_source).drop("c_title", "c_authors", "c_year")


def candidates(cites: DataFrame, registry: DataFrame, p: Params | None = None) -> DataFrame:
    """Deduplicated candidates of cites(citation_id, title, authors, year, doi, arxiv_id) in the order of their lexical score, cand_ord from 0.

    A second pass by first author and year serves citations for which the first one found no record with a title.
    """
    p = p or Params()
    records = known_sources(registry, p)
    strict = _pass(cites, records, p, False).withColumn("pass", F.lit(1))
    useful = strict.where(text("title") != "").select("citation_id").distinct()
    relaxed = _pass(cites.join(useful, "citation_id", "left_anti"), records, p, True).withColumn("pass", F.lit(2))
    return ordered(deduplicated(strict.unionByName(relaxed)))


def deduplicated(cands: DataFrame) -> DataFrame:
    """First of the records of a citation that share DOI and arXiv id, or title where there is none, in the order of sources."""
    key = [F.lower(text("doi")), F.coalesce(F.nullif(F.lower(text("arxiv_id")), F.lit("")), F.lower(strip(text("title"))))]
    first = F.row_number().over(Window.partitionBy("citation_id", *key).orderBy("pass", "source_rank", "place"))
    return cands.withColumn("rn", first).where("rn = 1").drop("rn")


def ordered(cands: DataFrame) -> DataFrame:
    w = Window.partitionBy("citation_id").orderBy(F.desc("lexical"), "pass", "source_rank", "place")
    return cands.withColumn("cand_ord", F.row_number().over(w) - 1)


def surname_overlap(a: Column, b: Column) -> Column:
    own = lambda x: F.array_distinct(F.transform(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda n: strip(n) != ""), surname))
    return jaccard(own(a), own(b))


def judge(cites: DataFrame, cands: DataFrame) -> DataFrame:
    """(citation_id, judge_score, judge_label, rationale, best_record_id): the best candidate by title, authors, year and DOI decides."""
    r = cands.select("citation_id", "cand_ord", *[F.col(c).alias(f"r_{c}") for c in ("record_id", "title", "authors", "year", "doi")])
    pairs = cites.join(r, "citation_id")
    title = jaccard(token_set("title", 2, False), token_set("r_title", 2, False))
    authors = surname_overlap(F.col("authors"), F.col("r_authors"))
    doi = (text("doi") != "") & (F.lower(text("doi")) == F.lower(text("r_doi")))
    year = (F.coalesce("year", F.lit(0)) != 0) & (F.col("year") == F.coalesce("r_year", F.lit(-1)))
    weighted = 0.55 * F.col("title_sim") + 0.25 * F.col("author_sim") + F.when(F.col("year_match"), 0.10).otherwise(0.0) + F.when(F.col("doi_match"), 0.10).otherwise(0.0)
    scored = pairs.withColumns({"title_sim": title, "author_sim": authors, "doi_match": doi, "year_match": year}).withColumn("s", F.when(F.col("doi_match"), F.greatest(weighted, F.lit(0.99))).otherwise(weighted))
    why = F.when(F.col("doi_match"), "DOI exact-match").otherwise(F.concat(F.format_string("title J=%.2f, authors=%.2f", "title_sim", "author_sim"), F.when(F.col("year_match"), ", year=match").otherwise("")))
    best = scored.groupBy("citation_id").agg(F.max_by(F.struct(F.col("s").alias("judge_score"), why.alias("rationale"), F.col("r_record_id").alias("best_record_id")), F.struct(F.col("s"), -F.col("cand_ord"))).alias("b"))
    named = (text("title") != "") | (text("doi") != "")
    nothing = F.when(named, "hallucinated").otherwise("unverifiable")
    joined = cites.join(best, "citation_id", "left")
    score = F.coalesce("b.judge_score", F.lit(0.0))
    label = F.when(F.col("b").isNull(), nothing).when(score >= 0.85, "verified").when(score >= 0.55, "partially_verified").otherwise(nothing)
    return joined.select("citation_id", score.alias("judge_score"), label.alias("judge_label"), F.coalesce("b.rationale", F.lit("No external candidates returned across enabled sources.")).alias("rationale"), F.col("b.best_record_id").alias("best_record_id"))


def liveness(urls: DataFrame, status: DataFrame, column: str = "url") -> DataFrame:
    """urls with reachable, archived and a class, by the latest probe of the normalised address."""
    latest = status.groupBy("url").agg(F.max_by(F.struct("http_status", "archived", "archive_url"), F.struct("checked_at", F.coalesce("http_status", F.lit(-1)), F.coalesce("archived", F.lit(False)))).alias("p"))
    joined = urls.withColumn("probe_url", normalised_url(F.col(column))).join(latest.withColumnRenamed("url", "probe_url"), "probe_url", "left")
    reachable = F.coalesce(F.col("p.http_status").between(200, 399), F.lit(False))
    archived = F.coalesce(F.col("p.archived"), F.lit(False))
    kind = F.when(reachable, "alive").when(archived, "link_rot").otherwise("dead")
    return joined.select(*urls.columns, F.col("p.http_status").alias("http_status"), reachable.alias("reachable"), archived.alias("archived"), kind.alias("liveness"))
