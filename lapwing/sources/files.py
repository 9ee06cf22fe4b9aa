"""Text, BibTeX, LaTeX, DOCX and JSON-lines readers. A missing path gives an empty table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.text import strip

BIB_SCHEMA = "path string, key string, raw string, title string, authors array<string>, year int, venue string, doi string, url string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\ufffd"), F.lit("")).alias("text"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files: each `@type{key, ...}` with its fields in braces or quotes."""
    files = read_texts(spark, path)
    entry = files.select("path", F.explode(F.split("text", r"(?m)(?=^\s*@\w+\s*\{)")).alias("e")).where(r"e rlike '^\\s*@\\w+\\s*\\{'")
    head = r"^\s*@(\w+)\s*\{\s*([^,\s]+)\s*,"
    fields = r"(?s)(\w+)\s*=\s*(?:\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}|\"([^\"]*)\"|(\d+))"
    names = F.regexp_extract_all("e", F.lit(fields), F.lit(1))
    values = F.transform(F.arrays_zip(*[F.regexp_extract_all("e", F.lit(fields), F.lit(g)).alias(f"v{g}") for g in (2, 3, 4)]), lambda x: F.concat(x["v2"], x["v3"], x["v4"]))
    # A field given twice counts as it stands first.
    mapped = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
    kept = entry.select("path", F.regexp_extract("e", head, 1).alias("kind"), F.regexp_extract("e", head, 2).alias("key"), mapped.alias("m"))
    get = lambda k: F.nullif(strip(F.regexp_replace(F.regexp_replace(F.try_element_at(F.filter("m", lambda x: x["k"] == k), F.lit(1))["v"], r"[{}]", ""), r"\s+", " ")), F.lit(""))
    return kept.select(
        "path", "key", F.concat(F.lit("@"), "kind", F.lit("{"), "key", F.lit(", ...}")).alias("raw"), get("title").alias("title"),
        F.coalesce(F.split(get("author"), r"\s+and\s+"), F.array().cast("array<string>")).alias("authors"), F.when(get("year").rlike(r"^\d+$"), get("year").cast("int")).alias("year"),
        F.coalesce(get("journal"), get("booktitle")).alias("venue"), get("doi").alias("doi"), get("url").alias("url"),
    )


def latex_bibliographies(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, entry columns): what the \\bibliography{a,b} of each LaTeX file names, in the folder of the file."""
    stems = texts.select("path", F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\bibliography\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))).alias("stem"))
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    wanted = stems.select("path", F.concat(folder(F.col("path")), F.regexp_replace(strip(F.col("stem")), r"\.bib$", ""), F.lit(".bib")).alias("bib"))
    return wanted.join(entries.withColumnRenamed("path", "bib"), "bib").drop("bib")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): paragraphs of Word files, or their bytes as text where they are none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, text string")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "ignore")
                    out.append("\n".join(re.sub(r"<[^>]+>", "", p) for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", xml)))
                except (zipfile.BadZipFile, KeyError):
                    out.append(bytes(content).decode("utf-8", "ignore"))
            yield pd.DataFrame({"path": b["path"].astype(object), "text": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, text string")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark prompts, one JSON object a line; lines that are none are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "user_prompt string, external_context array<string>")
    return spark.read.schema("user_prompt string, external_context array<string>").json(path, mode="DROPMALFORMED")
