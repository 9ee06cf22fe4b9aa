"""One query per operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions import citations as C
from lapwing.functions import similarity as S
from lapwing.functions import text as X
from lapwing.operators import claims, extract, link, patches, retrieve, score, search, threat
from lapwing.params import Params
from lapwing.session import written

P = Params()
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    """Each document once."""
    return table(spark, d, "manuscripts").select("doc_id", "user_prompt", "generated_text", "external_context").dropDuplicates(["doc_id"])


def registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registry").dropDuplicates(["record_id"])


def cites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations_flat")


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def pair_cosine(df: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, cosine) of the token bags of two columns, counted relationally so that long texts stay cheap."""
    sides = df.select("doc_id", F.explode(F.concat(F.transform(X.tokens(a), lambda t: F.struct(t.alias("t"), F.lit(0).alias("s"))), F.transform(X.tokens(b), lambda t: F.struct(t.alias("t"), F.lit(1).alias("s"))))).alias("x"))
    tf = sides.groupBy("doc_id", "x.t").agg(F.count_if(F.col("x.s") == 0).cast("double").alias("a"), F.count_if(F.col("x.s") == 1).cast("double").alias("b"))
    c = tf.groupBy("doc_id").agg(F.when((F.sum("a") == 0) | (F.sum("b") == 0), 0.0).otherwise(F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))).alias("c"))
    return df.select("doc_id").join(c, "doc_id", "left").select("doc_id", r6(F.coalesce("c", F.lit(0.0)), "cosine"))


def _found(pattern: str, group: int = 0) -> Query:
    return lambda s, d: manuscripts(s, d).select("doc_id", F.posexplode(C.every("generated_text", pattern, group)).alias("ord", "value"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    m = manuscripts(s, d)
    one = lambda pattern, style: m.select("doc_id", F.lit(style).alias("style"), F.explode(C.spans("generated_text", pattern)).alias("m")).select("doc_id", "style", "m.*")
    return one(C.NUMERIC, "numeric").unionByName(one(C.DOI, "doi"))


def _joined_authors(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("doc_id", *columns[:3], F.array_join("authors", "|").alias("authors"), *columns[3:])


def _sentinel(df: DataFrame, column: str, *ids: str) -> DataFrame:
    return df.select(*ids, threat.sentinel(column).alias("s")).select(*ids, r6("s.score", "score"), F.array_join("s.hits", ",").alias("hits"), "s.rule_matches")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return _sentinel(manuscripts(s, d).select("doc_id", F.posexplode("external_context").alias("chunk_ord", "chunk")), "chunk", "doc_id", "chunk_ord")


def _threat(s: SparkSession, d: str, **changes) -> DataFrame:
    return threat.threat_report(manuscripts(s, d).select("doc_id", "user_prompt", "external_context"), Params(**changes))


def _passes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = retrieve.known_sources(table(s, d, "registry"), P)
    strict = retrieve._pass(cites(s, d), records, P, False)
    useful = strict.where(X.text("title") != "").select("citation_id").distinct()
    return strict, retrieve._pass(cites(s, d).join(useful, "citation_id", "left_anti"), records, P, True)


def _cand(s: SparkSession, d: str) -> DataFrame:
    return retrieve.candidates(cites(s, d), table(s, d, "registry"), P)


def _linked(s: SparkSession, d: str) -> DataFrame:
    return written(link.linked(cites(s, d), _cand(s, d), P))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    c, k = cites(s, d), written(_cand(s, d))
    return link.verdicts(c, retrieve.judge(c, k), link.best(written(link.linked(c, k, P)), P), P)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each record's title with that of the record before it under the same DOI, and their Jaro and common substring."""
    before = F.lag("title").over(Window.partitionBy(F.lower("doi")).orderBy("record_id"))
    low = lambda c: F.lower(X.strip(c))
    rows = registry(s, d).where(X.text("doi") != "").select("record_id", low(F.col("title")).alias("a"), low(before).alias("b")).where("a <> '' and b <> ''")
    return rows.join(S.pair_scores(rows, "a", "b"), ["a", "b"])


def _signals(s: SparkSession, d: str) -> DataFrame:
    """Made-up signals that reach every band and rule."""
    i = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", (i * 37 % 101 / 100.0).cast("double").alias("p_injection"), (i * 53 % 97 / 96.0).cast("double").alias("u_intrinsic"), (i * 71 % 89 / 88.0).cast("double").alias("v_extrinsic"), (i % 7 == 0).alias("blocked"))


def _hrs(s: SparkSession, d: str) -> DataFrame:
    own = _signals(s, d).withColumn("score", score.hrs(*[F.col(c) for c in ("p_injection", "u_intrinsic", "v_extrinsic", "blocked")], P))
    return own.select("doc_id", r6("score", "score"), score.interpretation(F.col("score")).alias("interpretation"))


def _gate(s: SparkSession, d: str) -> DataFrame:
    c, k = cites(s, d), written(_cand(s, d))
    m = written(link.linked(c, k, P))
    v = link.verdicts(c, retrieve.judge(c, k), link.best(m, P), P).select("citation_id", "label")
    top = m.where("match_ord = 0").select("citation_id", "record_id", "similarity", "manifestation_conflict")
    i = F.col("citation_id")
    rows = patches.duplicate_flags(c).select("citation_id", "duplicate").join(v, "citation_id").join(top, "citation_id", "left")
    has = F.col("record_id").isNotNull()
    g = score.gate(F.col("label"), has, F.coalesce("manifestation_conflict", F.lit(False)), F.coalesce("similarity", F.lit(0.0)), (i * 37 % 101 / 100.0).cast("double"), i % 7 == 0, (i * 53 % 101).cast("double"), F.col("duplicate"), P)
    return rows.select("citation_id", g["rationale"].alias("rationale"), patches.action(F.col("label"), has).alias("action"))


def _record(f: Callable[..., Column], name: str, *columns: str) -> Query:
    return lambda s, d: registry(s, d).select("record_id", f(*[F.col(c) for c in columns]).alias(name))


def _tri(s: SparkSession, d: str) -> DataFrame:
    return claims.triplets(manuscripts(s, d), P)


def _claims(s: SparkSession, d: str) -> DataFrame:
    return claims.claims(_tri(s, d), cites(s, d))


def _dense(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))  # the one query vector
    return e.crossJoin(F.broadcast(first)).select("vec_id", r6(S.dense_cosine(F.col("embedding"), F.col("q")), "cosine"))


def _search(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id can be divided by 20 against all others."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return search.nearest(e.where("vec_id % 20 = 0"), e).select("query_id", F.col("id").alias("vec_id"), r6("cosine", "cosine"), "place")


def _labels(s: SparkSession, d: str) -> DataFrame:
    c = cites(s, d)
    return retrieve.judge(c, _cand(s, d)).join(c.select("citation_id", "doc_id"), "citation_id").withColumnRenamed("judge_label", "label")


def queries() -> dict[str, Query]:
    part = lambda f, *columns: lambda s, d: f(s, d).select(*columns)
    fields = [f"{f}_sim" for f in ("title", "authors", "venue", "year", "doi")]
    return {
        "sentence_split": lambda s, d: claims.split_sentences(manuscripts(s, d)),
        "token_bag": lambda s, d: table(s, d, "documents").select("doc_id", F.size(X.tokens("text")).alias("tokens"), F.size(X.token_set("text", 1)).alias("distinct_tokens")),
        "token_bag_cosine": lambda s, d: pair_cosine(manuscripts(s, d), "user_prompt", "generated_text"),
        "jaccard_titles": lambda s, d: registry(s, d).select("record_id", r6(X.jaccard(X.token_set("title", 2, False), X.token_set("abstract", 2, False)), "jaccard")),
        "lexical_entailment": lambda s, d: manuscripts(s, d).select("doc_id", r6(X.entailment(X.token_set("generated_text", 2, True, True), X.token_set("user_prompt", 2, True, True)), "entailment")),
        "hedge_rate": lambda s, d: table(s, d, "documents").groupBy("kind").agg(F.count("*").alias("docs"), F.count_if(X.hedged("text")).alias("hedged")),
        "sentinel_score": lambda s, d: _sentinel(manuscripts(s, d), "user_prompt", "doc_id"),
        "sentinel_hits": _chunks,
        "melon_cosine": lambda s, d: manuscripts(s, d).select("doc_id", r6(threat.melon_cosine(F.col("user_prompt"), F.col("external_context"), P), "cosine")),
        "threat_report": lambda s, d: _threat(s, d).select("doc_id", r6("sentinel_score", "sentinel_score"), r6("p_injection", "p_injection"), "aborted", "blocked"),
        "threat_report_fixed": lambda s, d: _threat(s, d, polarity="fixed").select("doc_id", r6("p_injection", "p_injection"), "blocked", threat.threat_class(F.col("p_injection"), F.col("blocked")).alias("threat_class")),
        "abort_rate": lambda s, d: threat.abort_rate(_threat(s, d)).select("total", "aborted", r6("abort_rate", "abort_rate")),
        "doi_extract": _found(C.DOI),
        "arxiv_extract": _found(C.ARXIV, 1),
        "url_extract": _found(C.URL),
        "citation_spans": _spans,
        "paren_citations": lambda s, d: _joined_authors(extract.parenthetical(manuscripts(s, d)), "raw", "span_start", "span_end", "year"),
        "narrative_citations": lambda s, d: _joined_authors(extract.narrative(manuscripts(s, d)), "raw", "span_start", "span_end", "year"),
        "numeric_citations": lambda s, d: extract.numeric(manuscripts(s, d), extract.references(manuscripts(s, d))).select("doc_id", "raw", "span_start", "span_end", "title", "doi"),
        "reference_parse": lambda s, d: _joined_authors(extract.references(manuscripts(s, d)), "ord", "raw", "title", "year", "venue", "doi", "arxiv_id", "url"),
        "extract_citations": lambda s, d: extract.extract_citations(manuscripts(s, d)).select("doc_id", "cite_ord", "style", "raw", "title", "year", "doi", "span_start", "span_end"),
        "unique_citations": lambda s, d: extract.unique_citations(cites(s, d)).select("citation_id"),
        "srl_frames": lambda s, d: claims.split_sentences(manuscripts(s, d)).select("doc_id", "sent_ord", claims.frame(F.col("sentence")).alias("f")).where("f is not null").select("doc_id", "sent_ord", "f.*"),
        "triplet_dedupe": part(_tri, "doc_id", "tri_ord", "subject", "relation", "object"),
        "claim_alignment": lambda s, d: _claims(s, d).select("doc_id", "tri_ord", "cite_ord", r6("entailment", "entailment"), "hedged"),
        "uncertainty": lambda s, d: claims.uncertainty(_claims(s, d), P).select("doc_id", "claims", r6("u_raw", "u_raw"), r6("u_intrinsic", "u_intrinsic")),
        "candidates_pass1": lambda s, d: _passes(s, d)[0].select("citation_id", "record_id", "source", "place", r6("lexical", "lexical")),
        "candidates_relaxed": lambda s, d: _passes(s, d)[1].select("citation_id", "record_id", "source", "place", r6("lexical", "lexical")),
        "record_dedupe": lambda s, d: _cand(s, d).groupBy("citation_id").agg(F.count("*").alias("records")),
        "rerank_topk": lambda s, d: _cand(s, d).where("cand_ord < 3").select("citation_id", "record_id", "cand_ord"),
        "judge": lambda s, d: retrieve.judge(cites(s, d), _cand(s, d)).select("citation_id", r6("judge_score", "judge_score"), "judge_label", "best_record_id"),
        "jaro": lambda s, d: _pairs(s, d).select("record_id", r6("jaro", "jaro")),
        "jaro_winkler": lambda s, d: _pairs(s, d).select("record_id", r6(S.jaro_winkler(F.col("jaro"), F.col("a"), F.col("b")), "jaro_winkler")),
        "lcs_length": part(_pairs, "record_id", "lcs"),
        "enhanced_jw": lambda s, d: _pairs(s, d).select("record_id", r6(S.enhanced(F.col("jaro"), F.col("lcs"), F.col("a"), F.col("b"), P), "similarity")),
        "field_similarity": lambda s, d: link.field_similarity(cites(s, d), _cand(s, d), P).select("citation_id", "record_id", *[r6(f, f) for f in fields], r6("similarity", "similarity")),
        "manifestation_conflict": part(_linked, "citation_id", "record_id", "manifestation_conflict"),
        "best_match": lambda s, d: link.best(_linked(s, d), P).select("citation_id", "record_id", r6("similarity", "similarity")),
        "verdict_label": part(_verdicts, "citation_id", "label"),
        "policy_gate": _gate,
        "liveness": lambda s, d: retrieve.liveness(cites(s, d).where("url is not null").select("citation_id", "url"), table(s, d, "url_status")).select("citation_id", "http_status", "reachable", "archived", "liveness"),
        "label_counts": lambda s, d: score.label_counts(_labels(s, d)),
        "v_extrinsic": lambda s, d: score.alignment(_labels(s, d)).select("doc_id", r6("v_extrinsic", "v_extrinsic")),
        "hrs_score": _hrs,
        "hrs_presets": lambda s, d: score.scored_presets(_signals(s, d)).select("doc_id", "preset", r6("score", "score")),
        "duplicate_keys": lambda s, d: patches.duplicate_flags(cites(s, d)).select("citation_id", "cite_key", "duplicate"),
        "bibtex": _record(patches.bibtex, "bibtex", "authors", "year", "title", "venue", "doi", "url", "manifestation"),
        "markdown_patch": _record(patches.markdown, "markdown", "authors", "year", "title", "venue", "doi", "url"),
        "citation_tier": lambda s, d: cites(s, d).select("citation_id", C.tier_of_citation(F.col("arxiv_id"), F.col("venue")).alias("tier")),
        "dense_rerank": _dense,
        "dense_search": _search,
        "top_matches": lambda s, d: _linked(s, d).where("match_ord < 3").select("citation_id", "record_id", "match_ord"),
        "verdict_counts": lambda s, d: score.label_counts(_verdicts(s, d)),
        "verdict_alignment": lambda s, d: score.alignment(_verdicts(s, d)).select("doc_id", r6("v_extrinsic", "v_extrinsic")),
        "audited_text": lambda s, d: manuscripts(s, d).select("doc_id", X.audited_text("generated_text", "user_prompt").alias("audited")),
        "valid_requests": lambda s, d: manuscripts(s, d).select("doc_id", X.valid_request(F.col("user_prompt"), F.col("generated_text"), F.lit("default")).alias("valid")),
        "action_tokens": lambda s, d: table(s, d, "documents").select("doc_id", X.action_token(F.col("kind"), F.col("lang")).alias("token")),
        "title_windows": lambda s, d: registry(s, d).where("title is not null").select("record_id", S.windows(F.lower("title"), P.jw_window).alias("w")).select("record_id", F.size("w").alias("windows"), F.size(F.array_distinct("w")).alias("distinct_windows")),
        "malicious_labels": lambda s, d: table(s, d, "documents").groupBy(threat.malicious_label(F.when(F.col("doc_id") % 3 == 0, "JailBreak").when(F.col("doc_id") % 3 == 1, F.col("kind"))).alias("malicious")).agg(F.count("*").alias("docs")),
        "report_summary": _summary,
    }


def _summary(s: SparkSession, d: str) -> DataFrame:
    from lapwing.plans.audit import audit, summary

    return summary(audit(manuscripts(s, d), table(s, d, "registry"), None, Params(polarity="fixed")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Verdict counts and safety score of each document: the report's summary."""
    return _summary(spark, d)
