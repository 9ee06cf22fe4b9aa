"""Layer 2: sentences, frames, triplets, their alignment with citations, and uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.text import entailment, hedged, once, sentences, strip, token_set
from lapwing.params import Params

# Verbs and copulas in the order in which they are tried.
VERBS = "proposed introduced demonstrated showed found reported argued claimed established developed evaluated investigated analyzed presented described discovered validated proved".split()
COPULAS = "is are was were has have".split()


def split_sentences(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    """(doc_id, sent_ord, sentence, span_start, span_end)."""
    return docs.select("doc_id", F.posexplode(sentences(column)).alias("sent_ord", "s")).select("doc_id", "sent_ord", "s.*")


def without_citations(c: Column) -> Column:
    """A sentence without bracketed references."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\(([^()]+\d{4}[a-z]?[^()]*)\)", ""), r"\[\d+(?:,\s*\d+)*\]", ""))


def frame(c: Column) -> Column:
    """(subject, predicate, object) by the first verb of the list, else the first copula, else the sentence as stated by this work; null if nothing is left."""
    return once(without_citations(c), _frame)


def _frame(clean: Column) -> Column:
    low = F.lower(clean)

    def cut(word: str, where: Column, rest_of_subject: str) -> Column:
        at = F.locate(f" {word} ", where)
        subject = F.rtrim(strip(F.substring(clean, F.lit(1), at - 1)), F.lit(rest_of_subject)) if rest_of_subject else strip(F.substring(clean, F.lit(1), at - 1))
        rest = F.rtrim(strip(F.substring(clean, at + len(word) + 2, F.length(clean))), F.lit("."))
        return F.when((at > 1) & (subject != "") & (rest != ""), F.struct(subject.alias("subject"), F.lit(word).alias("relation"), rest.alias("object")))

    options = [cut(v, low, ",;") for v in VERBS] + [cut(v, clean, "") for v in COPULAS]
    stated = F.when(clean != "", F.struct(F.lit("this work").alias("subject"), F.lit("states").alias("relation"), clean.alias("object")))
    return F.coalesce(*options, stated)


def triplets(docs: DataFrame, p: Params | None = None, column: str = "generated_text") -> DataFrame:
    """Distinct frames of a document with parts long enough, the first of equal ones kept."""
    p = p or Params()
    framed = split_sentences(docs, column).withColumn("f", frame(F.col("sentence"))).where("f is not null").select("doc_id", "sent_ord", "sentence", "span_start", "span_end", "f.*")
    parts = [strip(F.col(c)) for c in ("subject", "relation", "object")]
    long_enough = framed.where(F.least(*[F.length(x) for x in parts]) >= max(p.min_part_length, 1))
    first = F.row_number().over(Window.partitionBy("doc_id", *[F.lower(x) for x in parts]).orderBy("sent_ord"))
    kept = long_enough.withColumn("rn", first).where("rn = 1").drop("rn")
    return kept.withColumn("tri_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_ord")) - 1)


def align(tri: DataFrame, cites: DataFrame) -> DataFrame:
    """Each triplet with cite_ord of its citation: the first listed one that starts inside its sentence, else the nearest; null without any."""
    spanned = cites.where("span_start is not null").select("doc_id", "cite_ord", F.col("span_start").alias("c_start"), F.col("span_end").alias("c_end"))
    pairs = tri.join(spanned, "doc_id", "left")
    inside = F.col("c_start").between(F.col("span_start"), F.col("span_end"))
    apart = F.greatest(F.lit(0), F.col("c_start") - F.col("span_end"), F.col("span_start") - F.col("c_end"))
    order = F.struct((~inside).alias("a"), F.when(inside, 0).otherwise(apart).alias("b"), F.col("cite_ord").alias("c"))
    best = pairs.groupBy("doc_id", "tri_ord").agg(F.min_by("cite_ord", order).alias("cite_ord"))
    return tri.join(best, ["doc_id", "tri_ord"])


def claims(tri: DataFrame, cites: DataFrame) -> DataFrame:
    """Aligned triplets with the entailment of the triplet by its own sentence and whether the sentence hedges."""
    stopped = lambda c: token_set(c, 2, True, True)
    return align(tri, cites).withColumns({"entailment": entailment(stopped(F.col("sentence")), stopped(F.concat_ws(" ", "subject", "relation", "object"))), "hedged": hedged("sentence")})


def uncertainty(own: DataFrame, p: Params | None = None) -> DataFrame:
    """(doc_id, claims, u_raw, u_intrinsic) from claims: weak, hedged and uncited shares, squashed to [0, 1)."""
    p = p or Params()
    weak = 1.5 * F.count_if(F.col("entailment") < 0.5) + 0.5 * F.count_if("hedged") + 1.0 * F.count_if(F.col("cite_ord").isNull())
    raw = own.groupBy("doc_id").agg(F.count("*").alias("claims"), F.least(F.lit(p.high_entropy), weak / F.count("*")).alias("u_raw"))
    return raw.withColumn("u_intrinsic", normalised(F.col("u_raw"), p))


def normalised(raw: Column, p: Params) -> Column:
    return F.when(raw <= 0, F.lit(0.0)).otherwise(1 - F.exp(-raw / max(p.high_entropy, 1e-9)))


def mean_uncertainty(entropies: Column, logprobs: Column, claim_signal: Column, p: Params) -> Column:
    """Mean of what is known: floored mean entropy, mean negative log probability, claim signal."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    clean = F.transform(F.filter(entropies, lambda e: e.isNotNull()), lambda e: F.greatest(e, F.lit(p.entropy_floor)))
    known = F.array_compact(F.array(
        F.when(F.size(entropies) > 0, F.when(F.size(clean) > 0, total(clean) / F.size(clean)).otherwise(0.0)),
        F.when(F.size(logprobs) > 0, -total(logprobs) / F.size(logprobs)),
        claim_signal))
    return total(known) / F.greatest(F.size(known), F.lit(1))
