"""Layer 4: field similarities of citations and candidates, the best match and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.citations import tier_of_citation
from lapwing.functions.similarity import field_scores
from lapwing.functions.text import strip, text
from lapwing.params import MANIFESTATIONS, Params


def field_similarity(cites: DataFrame, cands: DataFrame, p: Params | None = None) -> DataFrame:
    """Candidates with title_sim, authors_sim, venue_sim, year_sim, doi_sim and their weighted similarity."""
    p = p or Params()
    own = cites.select("citation_id", *[F.col(c).alias(f"c_{c}") for c in ("title", "authors", "year", "venue", "doi", "arxiv_id")])
    low = lambda c: F.lower(strip(text(c)))
    names = lambda c, most: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most), low)
    # The first five authors cited against the record's first eight; all of a pair in one pass, without a shuffle.
    scores = field_scores(p)(low(F.col("c_title")), low(F.col("title")), low(F.col("c_venue")), low(F.col("venue")), names(F.col("c_authors"), 5), names(F.col("authors"), 8))
    pairs = cands.join(own, "citation_id").withColumn("_s", scores).withColumns({f"{f}_sim": F.col(f"_s.{f}") for f in ("title", "venue", "authors")}).drop("_s")
    year = F.when((F.coalesce("c_year", F.lit(0)) != 0) & (F.col("c_year") == F.coalesce("year", F.lit(-1))), 1.0).otherwise(0.0)
    doi = F.when((text("c_doi") != "") & (F.lower(text("c_doi")) == F.lower(text("doi"))), 1.0).otherwise(0.0)
    pairs = pairs.withColumns({"year_sim": year, "doi_sim": doi})
    weighted = sum((p.weights[f] * F.col(f"{f}_sim") for f in ("title", "authors", "venue", "year", "doi")), F.lit(0.0))
    return pairs.withColumn("similarity", F.least(F.lit(1.0), F.when(F.col("doi_sim") == 1, F.greatest(weighted, F.lit(0.99))).otherwise(weighted)))


def tier_rank(c: Column) -> Column:
    """Place of a manifestation in the order of authority; what is unknown comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MANIFESTATIONS]), F.lower(c)), F.lit(0)), F.lit(len(MANIFESTATIONS) + 1)).cast("int")


def conflict(cited: Column, found: Column) -> Column:
    """True if both manifestations are known and differ in rank."""
    f = F.coalesce(found, F.lit("unknown"))
    return (cited != "unknown") & (f != "unknown") & (tier_rank(cited) != tier_rank(f))


def linked(cites: DataFrame, cands: DataFrame, p: Params | None = None) -> DataFrame:
    """Candidates by falling similarity (match_ord from 0) with manifestation_conflict."""
    scored = field_similarity(cites, cands, p)
    cited = tier_of_citation(F.col("c_arxiv_id"), F.col("c_venue"))
    w = Window.partitionBy("citation_id").orderBy(F.desc("similarity"), "cand_ord")
    return scored.withColumns({"manifestation_conflict": conflict(cited, F.col("manifestation")), "match_ord": F.row_number().over(w) - 1})


def best(matches: DataFrame, p: Params | None = None) -> DataFrame:
    """(citation_id, record_id, similarity) of the match kept: none below the threshold without a DOI; else the most authoritative manifestation of all candidates, as in the published system."""
    p = p or Params()
    top = matches.where("match_ord = 0").where((F.col("similarity") >= p.jw_base) | (F.col("doi_sim") > 0)).select("citation_id")
    w = Window.partitionBy("citation_id").orderBy(tier_rank(F.col("manifestation")), "match_ord")
    return matches.join(top, "citation_id", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("citation_id", "record_id", "similarity", "manifestation")


def verdicts(cites: DataFrame, judged: DataFrame, kept: DataFrame, p: Params | None = None) -> DataFrame:
    """judged with the label lifted by the similarity of the best match."""
    p = p or Params()
    b = kept.select("citation_id", F.col("record_id").alias("match_record_id"), F.col("similarity").alias("match_similarity"))
    j = cites.select("citation_id", "doc_id").join(judged, "citation_id").join(b, "citation_id", "left")
    label = F.when(F.col("match_similarity") >= p.auto_apply_similarity, "verified").when((F.col("match_similarity") >= p.jw_base) & (F.col("judge_label") != "verified"), "partially_verified").otherwise(F.col("judge_label"))
    return j.withColumn("label", label)
