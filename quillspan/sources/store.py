"""A store of rows by key in a folder: snapshots that are written whole and then pointed at, so readers never see half of one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Rows by key. Every write makes a new snapshot; `current` names the one that is read, and is swapped last."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, order: str = "created_at"):
        self.spark, self.path, self.key, self.schema, self.order = spark, path.rstrip("/"), key, schema, order

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def snapshot(self) -> str | None:
        files, p = self._files(f"{self.path}/current")
        found = [x.getPath().getName() for x in files.listStatus(p)] if files.exists(p) else []
        return max(found).partition("-")[2] if found else None

    def swap(self, name: str) -> str | None:
        """Point at another snapshot; returns the one before. Pointers are numbered, the highest counts."""
        before = self.snapshot()
        files, p = self._files(f"{self.path}/current")
        number = len(files.listStatus(p)) if files.exists(p) else 0
        files.create(self._files(f"{self.path}/current/{number:08d}-{name}")[1]).close()
        return before

    def rows(self, tenant: str | None = None) -> DataFrame:
        name = self.snapshot()
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.schema)
        return df if tenant is None else df.where(F.col("tenant_id") == tenant)

    def write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.select(*self.rows().columns).write.parquet(f"{self.path}/{name}")
        self.swap(name)
        return name

    def upsert(self, incoming: DataFrame) -> int:
        """The latest incoming row of each key replaces the stored one; returns how many keys came."""
        some = incoming.where(F.col(self.key).isNotNull())
        last = some.withColumn("_r", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc_nulls_last(self.order)))).where("_r = 1").drop("_r")
        kept = self.rows().join(last.select(self.key), self.key, "left_anti")
        self.write(kept.unionByName(last.select(*kept.columns)))
        return some.select(self.key).distinct().count()

    def get(self, ids: DataFrame, tenant: str | None = None) -> DataFrame:
        """Rows of ids(place, key) in the order asked for."""
        return ids.join(self.rows(tenant), self.key).orderBy("place")

    def count(self, condition: Column | None = None, tenant: str | None = None) -> int:
        df = self.rows(tenant)
        return (df if condition is None else df.where(condition)).count()

    def delete(self, condition: Column, tenant: str | None = None) -> int:
        """Delete the tenant's rows that meet the condition; returns how many."""
        own = condition if tenant is None else condition & (F.col("tenant_id") == tenant)
        gone = F.coalesce(own, F.lit(False))
        n = self.rows().where(gone).count()
        if n:
            self.write(self.rows().where(~gone))
        return n

    def pages(self, size: int, condition: Column | None = None, tenant: str | None = None):
        """Rows in order of their key, a page at a time; each page starts behind the last key of the one before."""
        after = None
        while True:
            df = self.rows(tenant)
            df = df if condition is None else df.where(condition)
            page = (df if after is None else df.where(F.col(self.key) > after)).orderBy(self.key).limit(size).collect()
            if not page:
                return
            yield page
            after = page[-1][self.key]

    def health(self) -> dict:
        files, p = self._files(self.path)
        name = self.snapshot()
        return {"status": "green" if name else "empty", "snapshot": name, "rows": self.count(), "snapshots": sum(1 for x in files.listStatus(p) if x.getPath().getName() != "current") if files.exists(p) else 0}

    def vacuum(self) -> int:
        """Delete the snapshots that aren't pointed at; returns how many."""
        name, n = self.snapshot(), 0
        files, p = self._files(self.path)
        for x in files.listStatus(p) if files.exists(p) else []:
            if x.getPath().getName() not in ("current", name):
                files.delete(x.getPath(), True)
                n += 1
        return n


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, by day of their `at`; what was written is never changed."""
    events.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


# Fixed shapes of the stored tables.
DOCUMENTS = "id string, content string, source string, title string, checksum string, tenant_id string, metadata map<string,string>, created_at timestamp"
CHUNKS = "chunk_id string, document_id string, content string, chunk_index int, start_char int, end_char int, chunk_level int, parent_id string, modality string, token_count int, tenant_id string, metadata map<string,string>, embedding array<float>, created_at timestamp"


def tables_summary(tables: dict[str, DataFrame], samples: int = 3) -> DataFrame:
    """(table, column, type, rows, nulls, distinct, samples): what a question about the tables has to know, from one pass over each.

    Samples are the values of the smallest seeded hashes, so that no set of values is gathered.
    """
    out = None
    for name, df in tables.items():
        plain = [f for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "binary")]
        one = df.agg(F.count("*").alias("rows"), *[F.struct(F.count_if(F.col(f.name).isNull()).alias("nulls"), F.approx_count_distinct(f.name).alias("distinct"), F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.min_by(F.substring(F.col(f.name).cast("string"), 1, 40), F.when(F.col(f.name).isNotNull(), F.xxhash64(f.name, F.lit(j)))) for j in range(samples)])))).alias("samples")).alias(f"_{i}") for i, f in enumerate(plain)])
        long = F.explode(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), F.col(f"_{i}.nulls").alias("nulls"), F.col(f"_{i}.distinct").alias("distinct"), F.col(f"_{i}.samples").alias("samples")) for i, f in enumerate(plain)]))
        rows = one.select(long.alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def described_tables(summary: DataFrame) -> DataFrame:
    """(table, ddl): a table's columns as text, with sample values of the short text ones."""
    line = F.concat(F.lit("  "), F.col("column"), F.lit(" "), F.upper("type"), F.when(F.size("samples") > 0, F.concat(F.lit(" -- e.g. "), F.array_join("samples", ", "))).otherwise(""))
    by = summary.withColumn("line", line).groupBy("table").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list("line")).alias("lines"))
    return by.select("table", F.concat(F.lit("CREATE TABLE "), F.col("table"), F.lit(" ( -- "), F.col("rows").cast("string"), F.lit(" rows\n"), F.array_join("lines", ",\n"), F.lit("\n)")).alias("ddl"))
