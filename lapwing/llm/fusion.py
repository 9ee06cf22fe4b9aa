"""Best representative of each duplicate group (problem 4).

Bayesian fusion with copy detection over all groups at once. Each source claims
a value for a field of a group. From the current truth of every claim follow
the sources' accuracies and, from the false values two sources share against
those where they differ, how likely one copies the other; a vote counts less
the more of it is likely to be copied; the votes give the next truth. What the
driver sees is how many groups show each pattern of agreement among the sources,
which is all the estimates depend on. The surviving record
takes, field by field, the value of the highest posterior, and the record kept
is the one no worse than the others in most respects, then the one agreeing
with most fused values.

Defined cases: null and blank values are no claims; repeated rows of one record
count once; groups of one record are left out; ties go to the greater value and
the smaller record_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import written
from lapwing.llm.linkage import works

#: Manifestations from best to least.
MANIFESTATIONS = ("journal", "conference", "preprint", "arxiv", "unknown")
FIELDS = ("source", "manifestation", "doi", "venue")
COMPLETE = ("year", "venue", "doi", "arxiv_id", "url", "abstract")


@dataclass(frozen=True)
class Rules:
    rounds: int = 3
    #: Before anything is known: accuracy of a source, chance that one of two copies, share of values copied if so, false values in circulation.
    accuracy: float = 0.8
    copies: float = 0.2
    copied: float = 0.8
    false_values: int = 10
    #: Ways in which the sources may agree and differ on a value; their number depends on the sources only.
    max_patterns: int = 200_000


def _present(c: str, kind: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "") if kind == "string" else F.col(c).isNotNull()


def _claims(records: DataFrame) -> DataFrame:
    """(grp, field, value, source) of the claims that the sources make."""
    claims = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS[1:]])
    return records.where("source is not null").select("grp", "source", F.explode(claims).alias("x")).select("grp", "x.field", "x.value", "source").where("value is not null")


def _weights(kinds: set[tuple[str, ...]], accuracy: dict[str, float], copying: dict[tuple[str, str], float], rules: Rules) -> dict[tuple[str, ...], float]:
    """The weight of a value by the sources claiming it: their votes from the most accurate on, each discounted by what it may have copied from those before."""
    out = {}
    for kind in kinds:
        order = sorted(kind, key=lambda s: (-accuracy[s], s))
        out[kind] = sum(
            math.log(rules.false_values * accuracy[s] / (1 - accuracy[s])) * math.prod(1 - rules.copied * copying.get((min(s, t), max(s, t)), 0.0) for t in order[:k]) for k, s in enumerate(order)
        )
    return out


def _posteriors(pattern: list[tuple[str, ...]], weight: dict[tuple[str, ...], float], rules: Rules) -> list[float]:
    """Of each value of a pattern; values in circulation that nobody claims take their part."""
    most = max(weight[k] for k in pattern)
    scaled = [math.exp(weight[k] - most) for k in pattern]
    rest = max(0, rules.false_values + 1 - len(pattern)) * math.exp(-most)
    return [x / (sum(scaled) + rest) for x in scaled]


def learn(patterns: list[tuple[list[tuple[str, ...]], int]], rules: Rules) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Accuracies of the sources and chances that pairs of them copy, from (claimants of each value, number of groups) of every pattern."""
    accuracy = {s: rules.accuracy for p, _ in patterns for kind in p for s in kind}
    copying: dict[tuple[str, str], float] = {}
    for turn in range(rules.rounds + 1):
        # Before any value is known to be false, only how often two sources agree tells of copying; accuracies are left as they are.
        start = turn == 0
        weight = _weights({k for p, _ in patterns for k in p}, accuracy, copying, rules)
        right, votes = dict.fromkeys(accuracy, 0.0), dict.fromkeys(accuracy, 0)
        seen: dict[tuple[str, str], dict[str, float]] = {}
        for pattern, n in patterns:
            p = _posteriors(pattern, weight, rules)
            for x, kind in enumerate(pattern):
                for s in kind:
                    right[s] += p[x] * n
                    votes[s] += n
                for y, other in enumerate(pattern):
                    for a in kind:
                        for b in other:
                            if a < b:
                                pair = seen.setdefault((a, b), {"t": 0.0, "f": 0.0, "d": 0.0})
                                if x != y:
                                    pair["d"] += n
                                else:
                                    pair["t"] += n if start else n * p[x]
                                    pair["f"] += 0 if start else n * (1 - p[x])
        if not start:
            accuracy = {s: min(0.99, max(0.05, right[s] / votes[s])) for s in accuracy}
        for (a, b), pair in seen.items():
            mean, c = (accuracy[a] + accuracy[b]) / 2, rules.copied
            chance = {"t": mean**2 + start * (1 - mean) ** 2 / rules.false_values, "f": (1 - mean) ** 2 / rules.false_values}
            chance["d"] = max(1 - chance["t"] - chance["f"], 1e-6)
            given = {"t": c * (1.0 if start else mean) + (1 - c) * chance["t"], "f": c * (1 - mean) + (1 - c) * chance["f"], "d": max((1 - c) * chance["d"], 1e-6)}
            # Evidence of the mean claim, grown by the logarithm of their number only, so that many groups don't turn it into certainty.
            n = sum(pair.values())
            evidence = sum(k * math.log(given[x] / chance[x]) for x, k in pair.items()) / max(n, 1) * math.log1p(n)
            copying[a, b] = 1 / (1 + (1 - rules.copies) / rules.copies * math.exp(-max(-50.0, min(50.0, evidence))))
    return accuracy, copying


def fuse(claims: DataFrame, rules: Rules | None = None) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float]]:
    """Fused (grp, field, value, p), accuracies of the sources and chances that pairs of them copy."""
    rules = rules or Rules()
    spark = claims.sparkSession
    grouped = written(claims.groupBy("grp", "field", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), "\t").alias("kind")))
    patterns = grouped.groupBy("grp", "field").agg(F.array_join(F.array_sort(F.collect_list("kind")), "\n").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    rows = patterns.limit(rules.max_patterns + 1).collect()
    if len(rows) > rules.max_patterns:
        raise ValueError("the sources form more patterns of agreement than Rules.max_patterns")
    told = sorted(([tuple(k.split("\t")) for k in r.pattern.split("\n")], r.n) for r in rows)
    accuracy, copying = learn(told, rules)
    weight = _weights({k for p, _ in told for k in p}, accuracy, copying, rules)
    table = spark.createDataFrame([("\t".join(k), w) for k, w in sorted(weight.items())] or [("", 0.0)], "kind string, weight double")
    voted = grouped.join(F.broadcast(table), "kind")
    unclaimed = F.greatest(F.lit(0), rules.false_values + 1 - F.count("*"))
    fused = voted.groupBy("grp", "field").agg(F.max_by("value", F.struct("weight", "value")).alias("value"), (F.exp(F.max("weight")) / (F.sum(F.exp("weight")) + unclaimed)).alias("p"))
    return fused, accuracy, copying


def representatives(registry: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per group of two or more records of one work.

    group_id, best_id, its source, the fused manifestation, doi and venue with
    their posteriors, and whether best_id is no worse than every other record in
    all three respects and the only such one (sole_best).
    """
    kinds = dict(registry.dtypes)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, m in enumerate(MANIFESTATIONS) for x in (m, k)]), F.lower(F.trim("manifestation"))), F.lit(len(MANIFESTATIONS) - 1))
    mask = sum((F.when(_present(c, kinds[c]), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(COMPLETE)), F.lit(0))
    manifestation = F.nullif(F.lower(F.trim("manifestation")), F.lit("unknown"))
    venue = F.nullif(F.trim(F.lower(F.regexp_replace("venue", r"[\s\p{P}]+", " "))), F.lit(""))
    rows = written(works(registry, {"source": F.col("source"), "manifestation": manifestation, "venue": venue, "retrieved_at": F.col("retrieved_at"), "rank": rank, "mask": mask}).drop("form", "authors", "year"))
    bounds = rows.groupBy("work").agg(F.min("record_id").alias("grp"), F.max("record_id").alias("other"), F.expr("bit_or(mask)").alias("every"), F.max("retrieved_at").alias("latest"), F.min("rank").alias("top")).where("grp < other").drop("other")
    records = written(rows.join(bounds, "work").drop("work"))
    fused = fuse(_claims(records), rules)[0]
    wide = fused.groupBy("grp").agg(*[F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}{x}") for f in FIELDS[1:] for c, x in (("value", "_fused"), ("p", "_p"))])
    agree = sum((F.when(F.col(f) == F.col(f"{f}_fused"), F.col(f"{f}_p")).otherwise(F.lit(0.0)) for f in FIELDS[1:]), F.lit(0.0))
    sound = [F.col("mask") == F.col("every"), F.col("retrieved_at").eqNullSafe(F.col("latest")), F.col("rank") == F.col("top")]
    scored = records.join(wide, "grp", "left").withColumns({"respects": sum((s.cast("int") for s in sound), F.lit(0)), "agree": agree})
    whole = F.when(F.col("respects") == 3, F.col("record_id"))
    best = scored.groupBy("grp").agg(
        F.max_by(F.struct("record_id", "source", *[f"{f}{x}" for f in FIELDS[1:] for x in ("_fused", "_p")]), F.struct("respects", "agree", -F.col("record_id"))).alias("b"),
        (F.coalesce(F.min(whole) == F.max(whole), F.lit(False))).alias("sole_best"),
    )
    return best.select(F.col("grp").alias("group_id"), F.col("b.record_id").alias("best_id"), "b.source", *[F.col(f"b.{f}{x}").alias(f + ("" if x == "_fused" else x)) for f in FIELDS[1:] for x in ("_fused", "_p")], "sole_best")
