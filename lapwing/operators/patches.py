"""Rewrite patches: action, gate and the formats of the suggested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.citations import slug, stable_key
from lapwing.functions.text import strip, text
from lapwing.operators.score import gate
from lapwing.params import Params

# Entry type by manifestation.
ENTRY_TYPES = {"journal": "article", "conference": "inproceedings"}


def action(label: Column, has_record: Column) -> Column:
    return F.when(label == "verified", "noop").when((label == "hallucinated") & has_record, "replace").when(label == "hallucinated", "remove").otherwise("annotate")


def duplicate_flags(cites: DataFrame) -> DataFrame:
    """cites with their stable key and whether an earlier citation of the document has it."""
    keyed = cites.withColumn("cite_key", stable_key(*[F.col(c) for c in ("doi", "arxiv_id", "title", "raw")]))
    return keyed.withColumn("duplicate", F.row_number().over(Window.partitionBy("doc_id", "cite_key").orderBy("cite_ord")) > 1)


def bibtex(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column, manifestation: Column) -> Column:
    names = F.coalesce(authors, F.array().cast("array<string>"))
    last = F.when(F.size(names) > 0, F.try_element_at(F.split(strip(F.try_element_at(names, F.lit(1))), r"\s+"), F.lit(-1))).otherwise("anon")
    key = slug(F.concat(last, F.lit("_"), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n_d")), F.lit("_"), F.left(text(title), F.lit(30))))
    kind = F.lit("misc")
    for m, k in ENTRY_TYPES.items():
        kind = F.when(manifestation == m, k).otherwise(kind)
    line = lambda name, value, given: F.when(given, F.concat(F.lit(f"  {name.ljust(8)} = {{"), value, F.lit("}")))
    lines = F.array_compact(F.array(
        line("title", title, text(title) != ""), line("author", F.array_join(names, " and "), F.size(names) > 0), line("year", year.cast("string"), year.isNotNull()),
        line("journal", venue, text(venue) != ""), line("doi", doi, text(doi) != ""), line("url", url, text(url) != "")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def markdown(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    names = F.coalesce(authors, F.array().cast("array<string>"))
    link = F.when(text(url) != "", F.concat(F.lit(" [link]("), url, F.lit(")"))).when(text(doi) != "", F.concat(F.lit(" [DOI](https://doi.org/"), doi, F.lit(")"))).otherwise("")
    return F.concat(
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Unknown"), F.lit(". "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")),
        F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""), F.when(text(venue) != "", F.concat(F.lit(" — *"), venue, F.lit("*"))).otherwise(""), F.lit("."), link,
    )


def build(cites: DataFrame, verdicts: DataFrame, matches: DataFrame, scores: DataFrame, p: Params | None = None) -> DataFrame:
    """One patch per verdict from the top match; scores(doc_id, score, p_injection, blocked)."""
    p = p or Params()
    fields = ["title", "authors", "year", "venue", "doi", "url"]
    top = matches.where("match_ord = 0").select("citation_id", "record_id", "similarity", "manifestation", "manifestation_conflict", *[F.col(c).alias(f"r_{c}") for c in fields])
    keyed = duplicate_flags(cites).select("citation_id", "doc_id", "cite_ord", "cite_key", "duplicate")
    rows = keyed.join(verdicts.select("citation_id", "label"), "citation_id").join(top, "citation_id", "left").join(scores, "doc_id", "left")
    has = F.col("record_id").isNotNull()
    decided = rows.withColumn("gate", gate(F.col("label"), has, F.coalesce("manifestation_conflict", F.lit(False)), F.coalesce("similarity", F.lit(0.0)), F.coalesce("p_injection", F.lit(0.0)), F.coalesce("blocked", F.lit(False)), F.coalesce("score", F.lit(0.0)), F.col("duplicate"), p))
    r = [F.col(f"r_{c}") for c in ("authors", "year", "title", "venue", "doi", "url")]
    return decided.select(
        "doc_id", "cite_ord", "citation_id", "label", action(F.col("label"), has).alias("action"), "record_id", "cite_key", F.col("gate.safe").alias("safe_to_apply"), F.col("gate.manual").alias("requires_manual_review"), F.col("gate.rationale").alias("note"),
        F.when(has, bibtex(*r, F.col("manifestation"))).alias("bibtex"), F.when(has, markdown(*r)).alias("markdown"), F.when(has, F.to_json(F.struct("record_id", "manifestation", *[F.col(f"r_{c}").alias(c) for c in fields]))).alias("json_payload"),
    )


def serialised(patches: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, text): the patches of a document in one format; rows without the field are skipped."""
    w = F.array_sort(F.collect_list(F.struct("cite_ord", F.col({"json": "json_payload"}.get(fmt, fmt)).alias("x")))) if fmt in ("json", "bibtex", "markdown") else None
    if w is None:
        raise ValueError(f"Unsupported format {fmt!r}")
    parts = F.transform(F.filter("own", lambda r: r["x"].isNotNull()), lambda r: F.concat(F.lit("- "), r["x"]) if fmt == "markdown" else r["x"])
    joined = {"json": F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), "bibtex": F.array_join(parts, "\n\n"), "markdown": F.array_join(parts, "\n")}[fmt]
    return patches.groupBy("doc_id").agg(w.alias("own")).select("doc_id", joined.alias("text"))
