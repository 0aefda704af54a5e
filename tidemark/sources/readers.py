"""Text, JSON and XML scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.exprs import to_number


def read_delimited(spark: SparkSession, path: str, columns: list[str], numeric: list[str] = (), dates: list[str] = (),
                   sep: str = "|", header: bool = True) -> DataFrame:
    """All-string scan that drops malformed lines, then coerces."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep=sep, header=header, mode="DROPMALFORMED").csv(path)
    return df.select(*[to_number(c).alias(c) if c in numeric else F.col(c).try_cast("date").alias(c) if c in dates else F.col(c)
                       for c in columns])


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line under an explicit schema; broken lines give NULL rows and are dropped."""
    return (spark.read.text(path).select(F.from_json("value", schema).alias("d")).where("d is not null").select("d.*"))


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, row_schema: str) -> DataFrame:
    """Documents stored one per record; the repeated element becomes one row each."""
    schema = f"`{row_tag}` array<struct<{row_schema}>>"
    doc = spark.read.text(path).select(F.from_xml("value", schema).alias("d"))
    return doc.select(F.inline(F.col("d")[row_tag]))


def parse_form_index(lines: DataFrame, col: str = "value") -> DataFrame:
    """Fixed-width filing index, read from the right: the last three tokens are the entity number,
    the date and the file; form and company part at the first run of two or more spaces."""
    pat = r"^(\S.*?)\s{2,}(\S.*?)\s+(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"
    g = lambda i: F.regexp_extract(col, pat, i)
    return (lines.where(F.col(col).rlike(pat))
            .select(g(1).alias("form"), g(2).alias("company"), F.lpad(g(3), 10, "0").alias("cik"),
                    F.to_date(F.regexp_replace(g(4), "-", ""), "yyyyMMdd").alias("date_filed"), g(5).alias("filename")))
