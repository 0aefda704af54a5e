"""Table catalog: names to Parquet locations, snapshot preference, filtered loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import snapshots


@dataclass(frozen=True)
class TableSpec:
    """Raw location, optional curated snapshot, natural key and the columns that carry meaning."""
    raw: str
    curated: str | None = None
    prefix: str | None = None              # siblings in one directory are split by file prefix
    key: tuple[str, ...] = ()
    date_col: str | None = None
    symbol_col: str | None = None
    drifts: bool = False                   # files differ in their columns: every footer is read to merge them


# fixed values: natural keys of the hosted tables
WAREHOUSE_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}
WAREHOUSE_DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
WAREHOUSE_SYMBOLS = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_custkey", "lineitem": "l_suppkey", "events": "user_id"}


class Catalog:
    """Names to DataFrames; nothing is read until a name is used, nothing is collected."""

    def __init__(self, spark: SparkSession, specs: dict[str, TableSpec], use_curated: bool = True):
        self.spark, self.specs, self.use_curated = spark, specs, use_curated

    @classmethod
    def warehouse(cls, spark: SparkSession, sf_dir: str, **kw) -> "Catalog":
        return cls(spark, {n: TableSpec(f"{sf_dir}/{n}.parquet", key=k, date_col=WAREHOUSE_DATES.get(n),
                                        symbol_col=WAREHOUSE_SYMBOLS.get(n)) for n, k in WAREHOUSE_KEYS.items()}, **kw)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def resolve(self, name: str) -> str:
        """The curated snapshot when there is one and it is wanted, else the raw files."""
        if name not in self.specs:
            raise KeyError(f"unknown table {name!r}; known: {sorted(self.specs)}")
        s = self.specs[name]
        if self.use_curated and s.curated and snapshots.exists(self.spark, s.curated):
            return snapshots.current(self.spark, s.curated)
        return s.raw

    def read(self, name: str) -> DataFrame:
        path, s = self.resolve(name), self.specs[name]
        reader = self.spark.read.option("mergeSchema", "true" if s.drifts and path == s.raw else "false")
        if s.prefix and path == s.raw:
            reader = reader.option("pathGlobFilter", f"{s.prefix}*.parquet").option("recursiveFileLookup", "true")
        return reader.parquet(path)

    def load(self, name: str, symbols: list | None = None, start: str | None = None, end: str | None = None,
             columns: list[str] | None = None, limit: int | None = None, **equals) -> DataFrame:
        """Filtered load; every predicate is a Column, so it reaches the Parquet scan."""
        s = self.specs.get(name)
        df = self.read(name)
        if symbols is not None:
            df = df.where(F.col(s.symbol_col).isin(list(symbols)))
        for c, v in equals.items():
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
        if start is not None:
            df = df.where(F.col(s.date_col) >= F.lit(start).cast(df.schema[s.date_col].dataType))
        if end is not None:
            df = df.where(F.col(s.date_col) <= F.lit(end).cast(df.schema[s.date_col].dataType))
        if columns:
            df = df.select(*columns)
        return df.limit(limit) if limit is not None else df

    def register_views(self) -> list[str]:
        """Temp views for every table that can be read; a missing one is skipped."""
        done = []
        for name in self.specs:
            if self._exists(self.resolve(name)):
                self.read(name).createOrReplaceTempView(name)
                done.append(name)
        return done

    def sql(self, text: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(text)

    def tables(self) -> DataFrame:
        parts = [self.read(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n in sorted(self.specs)]
        return self._union(parts)

    def schema(self, name: str) -> DataFrame:
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(self.read(name).schema)]
        return self.spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")

    def describe(self, name: str) -> DataFrame:
        """The schema with what the rows hold: per column the rows, NULLs and distinct values (two-level, no set of values in one buffer)."""
        df = self.read(name)
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "true"}).alias("v"), F.col(c).isNull().alias("null")) for c in df.columns])).alias("x")).select("x.*")
        per = cells.groupBy("column", "v", "null").agg(F.count("*").alias("n"))
        stats = per.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("null"), F.col("n")).otherwise(0)).alias("n_null"), F.count(F.when(~F.col("null"), 1)).alias("n_distinct"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.schema(name).join(stats, "column", "left").select("position", "column", "type", "nullable", *[zero(c) for c in ("n_rows", "n_null", "n_distinct")])

    def symbols(self, name: str) -> DataFrame:
        c = self.specs[name].symbol_col
        return self.read(name).select(F.col(c).alias("symbol")).distinct().orderBy("symbol")

    def date_range(self) -> DataFrame:
        """First and last date per dated table; tables without a date are skipped."""
        parts = [self.read(n).agg(F.to_date(F.min(s.date_col)).alias("first_date"), F.to_date(F.max(s.date_col)).alias("last_date"))
                 .select(F.lit(n).alias("table"), "first_date", "last_date") for n, s in sorted(self.specs.items()) if s.date_col]
        return self._union(parts)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def read_drifting(spark: SparkSession, path_groups: list[list[str]], casts: dict[str, str]) -> DataFrame:
    """Files whose column types drifted: read per group of equal schema, cast, union by name."""
    out = None
    for paths in path_groups:
        df = spark.read.parquet(*paths)
        df = df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def storage_stats(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per first directory or file stem, from file metadata; contents are never
    read (only the listing columns of the binary source are selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(root).select("path", "length"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.parquet)?$", 1)
    return files.groupBy(stem.alias("table")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
