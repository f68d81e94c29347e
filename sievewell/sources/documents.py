"""Documents from folders, from SQL rows and from evaluation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vocabulary import SUFFIXES


def _pdf_text(data: bytes) -> str:
    try:
        from io import BytesIO

        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs pypdf") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(BytesIO(data)).pages)


def _pdf_texts(batches):
    for pdf in batches:
        yield pdf[["path"]].assign(text=[_pdf_text(x) for x in pdf.content])


def read_directory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, source, text) of all files below a folder with a known suffix (in any case); stripped, none empty.

    source is the file's name; path, relative to the folder, is the key.
    """
    if unknown := [s for s in suffixes if s not in SUFFIXES]:
        raise ValueError(f"unknown suffixes: {', '.join(unknown)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.filter(suffix.isin(*suffixes)).select("path", suffix.alias("suffix"), "content")
    texts = kept.filter("suffix <> '.pdf'").select("path", F.decode("content", "UTF-8").alias("text"))
    if ".pdf" in suffixes:
        texts = texts.unionByName(kept.filter("suffix = '.pdf'").select("path", "content").mapInPandas(_pdf_texts, "path string, text string"))
    base = folder.rstrip("/").rpartition("/")[2]
    relative = F.regexp_replace(F.col("path"), f"^.*/{base}/", "")
    return texts.select(relative.alias("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), strip(F.col("text")).alias("text")).filter("text <> ''").orderBy("path")


def row_documents(rows: DataFrame, id_col: str | None, prefix: str, order: list[str], max_rows: int | None = 100_000) -> DataFrame:
    """(source, text) of table rows: a line ``column: value`` for each value that is not null; blank rows are dropped.

    At most ``max_rows`` rows, the first in the given order; all of them for None.
    The key is the id's value or, without an id, ``row-`` and the row's number in the given order, dropped rows counted.
    """
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in rows.columns])
    first = rows if max_rows is None else rows.orderBy(*order).limit(max_rows)
    if id_col:
        keyed = first.select(F.concat(F.lit(f"{prefix}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias("source"), text.alias("text"))
    else:
        numbered = first.select(text.alias("text"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        # numbers for at most max_rows rows
        keyed = numbered.withColumn("__n", F.expr(f"row_number() over (order by {', '.join(f'__o{i}' for i in range(len(order)))})")).select(F.concat(F.lit(f"{prefix}:row-"), F.col("__n").cast("string")).alias("source"), "text")
    return keyed.filter(F.trim("text") != "")


def sql_documents(spark: SparkSession, query: str, id_col: str | None = None, prefix: str = "sql", order: list[str] | None = None, max_rows: int | None = 100_000) -> DataFrame:
    """(source, text) of the rows of one read-only query over registered tables; anything else raises UnsafeSQL and runs nothing.

    See row_documents. Rows are ordered by ``order``, else by all columns that can be: an ORDER BY of the query does not outlive
    a distributed plan. An ``id_col`` that the result lacks counts as none.
    """
    from ..plans.sql_gate import check

    check(spark, query)
    rows = spark.sql(query)
    by = order or [f.name for f in rows.schema if not f.dataType.typeName().startswith(("map", "variant"))]
    return row_documents(rows, id_col if id_col in rows.columns else None, prefix, [f"`{c}`" for c in by], max_rows)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_answer, relevant_doc_ids) of JSON lines; the last two default to empty."""
    df = spark.read.schema("question string, expected_answer string, relevant_doc_ids array<string>").json(path)
    return df.filter("question is not null").select("question", F.coalesce("expected_answer", F.lit("")).alias("expected_answer"), F.coalesce("relevant_doc_ids", F.expr("array()").cast("array<string>")).alias("relevant_doc_ids"))
