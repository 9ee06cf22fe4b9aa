"""Citations printed in a text: bibliography, parenthetical, narrative, numeric, DOI and arXiv mentions, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions import citations as C
from lapwing.functions.text import strip, text

COLUMNS = ["doc_id", "style", "ord", "raw", "title", "authors", "year", "venue", "doi", "url", "arxiv_id", "span_start", "span_end"]
_NONE = {"title": "string", "authors": "array<string>", "year": "int", "venue": "string", "doi": "string", "url": "string", "arxiv_id": "string", "span_start": "int", "span_end": "int"}


def _shaped(df: DataFrame) -> DataFrame:
    for c, t in _NONE.items():
        if c not in df.columns:
            df = df.withColumn(c, (F.array() if c == "authors" else F.lit(None)).cast(t))
    return df.select(*COLUMNS)


def references(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    """Parsed bibliography entries with their position (ord from 0)."""
    own = docs.select("doc_id", F.posexplode(C.reference_entries(column)).alias("ord", "entry")).select("doc_id", "ord", C.parse_reference(F.col("entry")).alias("r"))
    return _shaped(own.select("doc_id", F.lit(0).alias("style"), "ord", "r.*"))


def _mentions(docs: DataFrame, column: str, pattern: str, style: int) -> DataFrame:
    return docs.select("doc_id", F.lit(style).alias("style"), F.posexplode(C.spans(column, pattern)).alias("ord", "m")).select("doc_id", "style", "ord", "m.*")


def parenthetical(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    m = _mentions(docs, column, C.PARENTHETICAL, 1).withColumn("inner", F.expr("substring(raw, 2, length(raw) - 2)"))
    names = F.split(strip(F.regexp_replace("inner", r",\s*(\d{4}[a-z]?)$", "")), r"\s+(?:and|&)\s+|,\s*")
    return _shaped(m.withColumns({"authors": F.filter(F.transform(names, strip), lambda a: a != ""), "year": C.year_of(F.regexp_extract("inner", r",\s*(\d{4}[a-z]?)$", 1))}))


def narrative(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    m = _mentions(docs, column, C.NARRATIVE, 2)
    return _shaped(m.withColumns({"authors": F.array(strip(F.regexp_extract("raw", r"^(.*?)\s+\((\d{4}[a-z]?)\)$", 1))), "year": C.year_of(F.regexp_extract("raw", r"\((\d{4}[a-z]?)\)$", 1))}))


def numeric(docs: DataFrame, refs: DataFrame, column: str = "generated_text") -> DataFrame:
    """Each number of a marker with the entry it points to; ranges give their ends only, as in the published system."""
    m = _mentions(docs, column, C.NUMERIC, 3).select("doc_id", "ord", "span_start", "span_end", F.posexplode(F.split(F.expr("substring(raw, 2, length(raw) - 2)"), r"[,\-]")).alias("sub", "piece"))
    m = m.withColumn("piece", strip(F.col("piece")))
    m = m.where("piece rlike '^[0-9]+$'").withColumn("n", F.expr("try_cast(piece AS bigint) - 1"))
    entries = refs.select("doc_id", F.col("ord").cast("bigint").alias("n"), "title", "authors", "year", "venue", "doi", "url", "arxiv_id")
    joined = m.join(entries, ["doc_id", "n"], "left").withColumns({"raw": F.concat(F.lit("["), "piece", F.lit("]")), "ord": F.col("ord") * 1000 + F.col("sub"), "style": F.lit(3), "authors": F.coalesce("authors", F.array().cast("array<string>"))})
    return _shaped(joined)


def identifiers(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    dois = _mentions(docs, column, C.DOI, 4).withColumn("doi", F.col("raw"))
    arxiv = _mentions(docs, column, C.ARXIV, 5).withColumn("arxiv_id", F.regexp_extract("raw", C.ARXIV, 1))
    return _shaped(dois).unionByName(_shaped(arxiv))


def extract_citations(docs: DataFrame, column: str = "generated_text") -> DataFrame:
    """All mentions of docs(doc_id, text) with cite_ord, their place in the list by style and position."""
    own = docs.select("doc_id", text(column).alias(column))
    refs = references(own, column)
    every = refs
    for part in (parenthetical(own, column), narrative(own, column), numeric(own, refs, column), identifiers(own, column)):
        every = every.unionByName(part)
    return every.withColumn("cite_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("style", "ord")) - 1).drop("ord")


def unique_citations(cites: DataFrame) -> DataFrame:
    """First mention of each (DOI, title, year) of a document; the key knows nothing else, as in the published system."""
    key = [F.lower(text(c)) for c in ("doi", "title")] + [F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit(""))]
    first = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("cite_ord"))
    return cites.withColumn("rn", first).where("rn = 1").drop("rn")
