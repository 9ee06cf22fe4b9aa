"""Layer 5: alignment with verified citations, the safety score and its policy gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.text import text
from lapwing.params import LABELS, PRESETS, Params

# Bands of the score.
BANDS = (
    (90, "Fully verified and safe — auto-apply suggested patches."),
    (75, "Mostly verified — review high-risk patches manually."),
    (50, "Mixed signal — manual audit strongly recommended."),
    (25, "High risk — block automated rewrites; human review required."),
    (None, "Critically compromised — discard generation and resample."),
)


def verdict_claims(verdicts: DataFrame, cites: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, cite_ord, tri_ord, label): claims that cite what a verdict is about, by DOI, title or span; a verdict without any borrows the first uncited claim; documents without verdicts count all claims as unverifiable."""
    fields = ["doi", "title", "span_start", "span_end"]
    cited = claims.where("cite_ord is not null").select("doc_id", "tri_ord", "cite_ord").join(cites.select("doc_id", "cite_ord", *[F.col(c).alias(f"q_{c}") for c in fields]), ["doc_id", "cite_ord"]).drop("cite_ord")
    own = verdicts.select("doc_id", "cite_ord", "label").join(cites.select("doc_id", "cite_ord", *fields), ["doc_id", "cite_ord"])
    same = [(text(c) != "") & (F.lower(text(c)) == F.lower(text(f"q_{c}"))) for c in ("doi", "title")]
    spans = F.col("span_start").isNotNull() & (F.col("span_start") == F.col("q_span_start")) & (F.col("span_end") == F.col("q_span_end"))
    related = own.join(cited, "doc_id").where(same[0] | same[1] | spans).select("doc_id", "cite_ord", "tri_ord", "label")
    spare = claims.where("cite_ord is null").groupBy("doc_id").agg(F.min("tri_ord").alias("tri_ord"))
    borrowed = own.join(related.select("doc_id", "cite_ord").distinct(), ["doc_id", "cite_ord"], "left_anti").join(spare, "doc_id").select("doc_id", "cite_ord", "tri_ord", "label")
    tuples = related.unionByName(borrowed)
    rest = claims.join(tuples.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("cite_ord"), "tri_ord", F.lit("unverifiable").alias("label"))
    return tuples.unionByName(rest)


def alignment(tuples: DataFrame) -> DataFrame:
    """(doc_id, v_extrinsic): share of verified tuples, partly verified ones counting half."""
    return tuples.groupBy("doc_id").agg(F.avg(F.when(F.col("label") == "verified", 1.0).when(F.col("label") == "partially_verified", 0.5).otherwise(0.0)).alias("v_extrinsic"))


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hrs(p_injection: Column, u: Column, v: Column, blocked: Column, p: Params) -> Column:
    """Safety score from 0 to 100; what is blocked gets 5 at most."""
    score = 100 * clipped(1 - p.alpha * clipped(p_injection) - p.beta * clipped(u) + p.gamma * clipped(v))
    return F.when(blocked, F.least(score, F.lit(5.0))).otherwise(score)


def interpretation(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, said in BANDS[1:-1]:
        out = out.when(score >= least, said)
    return out.otherwise(BANDS[-1][1])


def scored_presets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, p_injection, u_intrinsic, v_extrinsic, blocked) with the score under each preset."""
    rows = [(n, *[getattr(Params(**c), k) for k in ("alpha", "beta", "gamma")]) for n, c in PRESETS.items()]
    table = docs.sparkSession.createDataFrame(rows, "preset string, alpha double, beta double, gamma double")
    part = lambda k, c: F.col(k) * clipped(F.col(c))
    raw = 100 * clipped(1 - part("alpha", "p_injection") - part("beta", "u_intrinsic") + part("gamma", "v_extrinsic"))
    # Three rows of parameters, whatever the documents.
    return docs.crossJoin(F.broadcast(table)).withColumn("score", F.when(F.col("blocked"), F.least(raw, F.lit(5.0))).otherwise(raw))


def gate(label: Column, has_match: Column, in_conflict: Column, similarity: Column, p_injection: Column, blocked: Column, score: Column, duplicate: Column, p: Params) -> Column:
    """(safe, manual, rationale): the first rule that applies."""

    def said(safe: bool, why: Column | str) -> Column:
        return F.struct(F.lit(safe).alias("safe"), F.lit(not safe).alias("manual"), (F.lit(why) if isinstance(why, str) else why).alias("rationale"))

    bad = label == "hallucinated"
    return (
        F.when(blocked | (p_injection >= p.block_on_injection), said(False, F.format_string(f"Blocked: P_inj=%.2f ≥ {p.block_on_injection:.2f}", p_injection)))
        .when(duplicate & F.lit(p.forbid_duplicate_keys), said(False, "Refusing to overwrite duplicate citation key."))
        .when(bad & ~has_match, said(False, "Hallucinated citation has no candidate replacement."))
        .when(bad & in_conflict, said(False, "Manifestation conflict — Journal>Conference>Preprint policy requires human approval."))
        .when(bad & (score >= p.auto_apply_min_score) & (similarity >= p.auto_apply_similarity), said(True, "High-confidence replacement and adequate safety score."))
        .when(bad, said(False, "Suggested replacement requires manual review."))
        .when(label == "partially_verified", said(False, "Partial verification — emit annotation only."))
        .when(label == "verified", said(True, "Citation already verified; no patch needed."))
        .otherwise(said(False, "Unverifiable claim — escalate for human review."))
    )


def label_counts(verdicts: DataFrame) -> DataFrame:
    """One row per document with the number of verdicts under each label, zeros included."""
    return verdicts.groupBy("doc_id").agg(*[F.count_if(F.col("label") == x).alias(x) for x in LABELS])
