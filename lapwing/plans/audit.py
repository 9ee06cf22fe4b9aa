"""The whole audit as one set of lazy tables, and the report that gathers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators import claims as claims_
from lapwing.operators import extract, link, patches, retrieve, score, threat
from lapwing.params import Params
from lapwing.session import written

#: Safety score below which a run counts as failed.
LEAST_SCORE = 25.0


def failed(tables: dict[str, DataFrame], least: float = LEAST_SCORE) -> bool:
    """True if any document scores below `least`: a command's exit code 2."""
    return not tables["safety"].where(F.col("score") < least).isEmpty()


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The report as JSON, one document a line: its summary with its verdicts and patches."""
    gathered = lambda name, order: tables[name].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in tables[name].columns if c not in ("doc_id", order)]))).alias(name))
    report = summary(tables).join(gathered("verdicts", "cite_ord"), "doc_id", "left").join(gathered("patches", "cite_ord"), "doc_id", "left")
    report.write.mode("overwrite").json(path)


def show(tables: dict[str, DataFrame], rows: int = 20, width: int = 60) -> None:
    """The summary and the patches on the console, long texts cut for display."""
    for df in (summary(tables), tables["patches"].select("doc_id", "cite_ord", "label", "action", "note")):
        df.orderBy("doc_id").show(rows, width)


def audit(docs: DataFrame, registry: DataFrame, url_status: DataFrame | None = None, p: Params | None = None) -> dict[str, DataFrame]:
    """Tables of all layers for docs(doc_id, user_prompt, generated_text, external_context). Blocked documents stop after the first layer.

    What several stages read is written to the shared folder once.
    """
    p = p or Params()
    threats = written(threat.threat_report(docs.select("doc_id", "user_prompt", "external_context"), p))
    clear = docs.join(threats.where("blocked").select("doc_id"), "doc_id", "left_anti")
    cites = written(extract.extract_citations(clear))
    tri = claims_.triplets(clear, p)
    own = written(claims_.claims(tri, cites))
    unique = written(extract.unique_citations(cites).withColumn("citation_id", F.concat_ws(":", "doc_id", "cite_ord")))
    cands = written(retrieve.candidates(unique, registry, p))
    judged = retrieve.judge(unique, cands)
    matches = written(link.linked(unique, cands, p))
    verdicts = written(link.verdicts(unique, judged, link.best(matches, p), p).join(unique.select("citation_id", "cite_ord"), "citation_id"))
    u = claims_.uncertainty(own, p)
    v = score.alignment(score.verdict_claims(verdicts, cites, own))
    signals = threats.select("doc_id", "p_injection", "blocked").join(u.select("doc_id", "u_intrinsic"), "doc_id", "left").join(v, "doc_id", "left")
    signals = signals.select("doc_id", "p_injection", "blocked", F.when(F.col("blocked"), 1.0).otherwise(F.coalesce("u_intrinsic", F.lit(0.0))).alias("u_intrinsic"), F.when(F.col("blocked"), 0.0).otherwise(F.coalesce("v_extrinsic", F.lit(0.0))).alias("v_extrinsic"))
    safety = signals.withColumn("score", score.hrs(*[F.col(c) for c in ("p_injection", "u_intrinsic", "v_extrinsic", "blocked")], p)).withColumn("interpretation", score.interpretation(F.col("score")))
    safety = written(safety)
    fixes = patches.build(unique, verdicts, matches, safety.select("doc_id", "score", "p_injection", "blocked"), p)
    out = {"threats": threats, "citations": cites, "claims": own, "candidates": cands, "matches": matches, "verdicts": verdicts, "safety": safety, "patches": fixes}
    if url_status is not None:
        out["liveness"] = retrieve.liveness(unique.where("url is not null").select("citation_id", "url"), url_status)
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per document: score, signals, numbers of claims, verdicts by label and patches by fate."""
    n = tables["claims"].groupBy("doc_id").agg(F.count("*").alias("claims"))
    fixed = tables["patches"].groupBy("doc_id").agg(F.count_if("safe_to_apply").alias("patches_auto"), F.count_if("requires_manual_review").alias("patches_manual"))
    joined = tables["safety"].join(n, "doc_id", "left").join(score.label_counts(tables["verdicts"]), "doc_id", "left").join(fixed, "doc_id", "left")
    return joined.na.fill(0)
