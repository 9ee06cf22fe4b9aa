"""Columns over text: trimming, tokens, sentences with spans, bags of tokens and set overlaps.

Character classes are ASCII ones, so that every engine agrees. A null text acts
like an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = "the a an is are was were be been being of to and or for in on at with by as this that these those it its their our we they".split()
HEDGES = "might may could possibly perhaps likely probably seems appears suggests believed reportedly allegedly".split()


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column | str, least: int = 1, underscore: bool = True) -> Column:
    """Lower-case runs of letters, digits and (unless told otherwise) underscores, in order."""
    own = "[A-Za-z0-9_]" if underscore else "[A-Za-z0-9]"
    return F.transform(F.regexp_extract_all(text(c), F.lit(f"{own}{{{least},}}"), F.lit(0)), F.lower)


def token_set(c: Column | str, least: int = 2, underscore: bool = True, stopwords: bool = False) -> Column:
    own = F.array_distinct(tokens(c, least, underscore))
    return F.array_except(own, F.array(*[F.lit(w) for w in STOPWORDS])) if stopwords else own


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def entailment(premise: Column, hypothesis: Column) -> Column:
    """Lexical entailment of hypothesis by premise, both sets of tokens without stopwords."""
    shared = F.size(F.array_intersect(premise, hypothesis)).cast("double")
    score = F.least(F.lit(1.0), 0.7 * (shared / F.size(hypothesis)) + 0.3 * (shared / F.size(premise)))
    return F.when((F.size(premise) == 0) | (F.size(hypothesis) == 0), F.lit(0.0)).otherwise(score)


def hedged(c: Column | str) -> Column:
    return text(c).rlike(r"(?i)\b(" + "|".join(HEDGES) + r")\b")


def sentences(c: Column | str) -> Column:
    """Array of (sentence, span_start, span_end): cut at white space between an end mark and a capital or bracket; spans count code points."""
    # \u0001 before and after each gap, so that odd elements are gaps and a running length gives the spans.
    parts = F.split(F.regexp_replace(text(c), r"(?<=[.!?])(\s+)(?=[A-Z(])", "\u0001$1\u0001"), "\u0001")
    start = F.lit(0)
    folded = F.aggregate(
        parts,
        F.struct(start.alias("at"), F.array().cast("array<struct<sentence:string,span_start:int,span_end:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.concat(
                acc["out"],
                F.when(
                    strip(p) != "",
                    F.array(
                        F.struct(
                            strip(p).alias("sentence"),
                            (acc["at"] + F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))).alias("span_start"),
                            (acc["at"] + F.length(F.regexp_replace(p, r"\s+$", ""))).alias("span_end"),
                        )
                    ),
                ).otherwise(F.array().cast("array<struct<sentence:string,span_start:int,span_end:int>>")),
            ).alias("out"),
        ),
    )
    return folded["out"]


def marked(c: Column, pattern: str) -> Column:
    """Text cut around every match: even elements lie between matches, odd ones are the matches. The pattern must use numbered groups counted from 2."""
    return F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1\u0001"), "\u0001")


def once(value: Column, use) -> Column:
    """use(value) with value evaluated a single time per row, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two arrays of tokens, 0 if either is empty."""

    def cosine(pair: Column) -> Column:
        count = lambda side, t: F.size(F.filter(pair[side], lambda x: x == t)).cast("double")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        norm = lambda side: F.sqrt(total(F.transform(F.array_distinct(pair[side]), lambda t: count(side, t) * count(side, t))))
        dot = total(F.transform(F.array_intersect(pair["a"], pair["b"]), lambda t: count("a", t) * count("b", t)))
        return F.when((F.size(pair["a"]) == 0) | (F.size(pair["b"]) == 0), F.lit(0.0)).otherwise(dot / (norm("a") * norm("b")))

    return once(F.struct(a.alias("a"), b.alias("b")), cosine)


def action_token(name: Column, arguments: Column) -> Column:
    """Token of an action: its name and canonical arguments, hashed."""
    return F.concat(F.lit("act_"), F.left(F.sha1(F.concat(name, F.lit("::"), text(arguments))), F.lit(12)))


def audited_text(generated: Column | str, prompt: Column | str) -> Column:
    """The generated text, or the prompt where there is none."""
    return F.coalesce(F.nullif(text(generated), F.lit("")), text(prompt))


# Most characters of a request, and its presets.
MOST_PROMPT, MOST_TEXT, REQUEST_PRESETS = 32_000, 200_000, ("default", "strict", "lenient")


def valid_request(prompt: Column, generated: Column, preset: Column) -> Column:
    """True if a request keeps within its lengths and names a preset."""
    return (text(prompt) != "") & (F.length(text(prompt)) <= MOST_PROMPT) & (F.length(text(generated)) <= MOST_TEXT) & F.coalesce(preset.isin(*REQUEST_PRESETS), F.lit(False))
