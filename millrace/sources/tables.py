"""Tables kept by key: inserts, updates and deletes as copies of the buckets they touch, and catalogues imported by natural key.

A table is a folder of Parquet buckets, by a hash of the key, and of commits. A commit is a small file that names the
folder of each bucket; writing one is the only step that changes the table. It is created under the next number and
never replaces another, so of two writers that began from one state one fails; a writer that dies half way leaves
folders that no commit names, and the old state. Buckets that a change doesn't touch are neither read nor written.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.catalog import Catalog
from millrace.io import load, shared_folder
from millrace.sources.files import catalogue_csv

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql


class Conflict(Exception):
    """Another writer has committed first."""


class KeyedTable:
    """A table with a key. schema: DDL of all columns; buckets: how many, fixed when the table is made."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self.names = self.schema.names
        if missing := set(key) - set(self.names):
            raise ValueError(f"no such key columns: {sorted(missing)}")

    # -------------------------------------------------------------------- commits

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def files(self):
        return self.path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        fs, at = self.files(), self.path("commits")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def places(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.files().open(self.path(f"commits/{version:012}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def commit(self, version: int, places: dict[int, str]) -> None:
        """Name the folders of all buckets in the commit that follows `version`."""
        try:
            out = self.files().create(self.path(f"commits/{version + 1:012}"), False)
        except Exception as e:
            raise Conflict(f"version {version + 1} is there already") from e
        try:
            out.write(json.dumps(places).encode())
        finally:
            out.close()

    # -------------------------------------------------------------------- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a commit, the last one if none is given."""
        places = self.places(version)
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in places.values()))

    def checked(self, rows: DataFrame, partial: bool = False) -> DataFrame:
        """Rows as columns of the table; unknown columns, missing keys and repeated keys are refused."""
        if unknown := set(rows.columns) - set(self.names):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        if missing := set(self.key if partial else self.names) - set(rows.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        kinds = {f.name: f.dataType for f in self.schema}
        return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in self.names if c in rows.columns))

    def refuse(self, rows: DataFrame, why: str) -> None:
        if row := rows.select(*self.key).first():
            raise ValueError(f"{why}: {row.asDict()}")

    def change(self, rows: DataFrame, merged) -> int:
        """Write the buckets of rows anew, as merged(old, rows) gives them, and commit. Returns the new version."""
        version = self.version()
        places = self.places(version)
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        self.refuse(rows.where(" or ".join(f"`{k}` is null" for k in self.key)), "null in the key")
        self.refuse(rows.groupBy(*self.key).count().where("count > 1"), "repeated key")
        touched = [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return version
        old = [places[b] for b in touched if b in places]
        before = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in old)) if old else self.spark.createDataFrame([], self.schema)
        new = f"data/{uuid.uuid4().hex}"
        merged(before, rows).select(*self.names).withColumn("bucket_", self.bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.folder}/{new}")
        written = {int(s.getPath().getName().split("=")[1]) for s in self.files().listStatus(self.path(new)) if s.getPath().getName().startswith("bucket_=")}
        self.commit(version, {b: p for b, p in places.items() if b not in touched} | {b: f"{new}/bucket_={b}" for b in touched if b in written})
        return version + 1

    def insert(self, rows: DataFrame) -> int:
        """New rows; a key that is there already is refused, and then none is inserted."""

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            self.refuse(new.join(old, self.key, "left_semi"), "key exists")
            return old.unionByName(new)

        return self.change(self.checked(rows), merged)

    def upsert(self, rows: DataFrame, clear: tuple[str, ...] = ()) -> int:
        """Rows by key: known values go over old ones, nulls leave them as they are but in the columns to clear."""
        rows = self.checked(rows, partial=True)

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            return self.over(old, new, clear, "full")

        return self.change(rows, merged)

    def update(self, rows: DataFrame, clear: tuple[str, ...] = ()) -> int:
        """The same for keys that are there; others are refused."""
        rows = self.checked(rows, partial=True)

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            self.refuse(new.join(old, self.key, "left_anti"), "no such key")
            return self.over(old, new, clear, "left")

        return self.change(rows, merged)

    def over(self, old: DataFrame, new: DataFrame, clear: tuple[str, ...], how: str) -> DataFrame:
        given = [c for c in new.columns if c not in self.key]
        fresh = new.select(*self.key, *(F.col(c).alias(f"new_{c}") for c in given), F.lit(True).alias("new_"))
        both = old.join(fresh, self.key, how)
        value = lambda c: F.when(F.col("new_"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"new_{c}", c)
        return both.select(*self.key, *((value(c) if c in given else F.col(c)).alias(c) for c in self.names if c not in self.key))

    def delete(self, keys: DataFrame) -> int:
        """The rows of these keys go; keys that aren't there don't matter."""
        return self.change(self.checked(keys.select(*self.key), partial=True).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))


def natural_id(*parts: str) -> Column:
    """Sixteen hex digits from the normal forms of the parts of a natural key."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(p), F.lit("")), r"\s+", " "))) for p in parts))), 1, 16)


def import_catalogue(table: KeyedTable, path: str, headers: dict[str, str], natural: tuple[str, ...], sep: str = ",") -> dict[str, int]:
    """Upsert a delimited file with quoted fields into a table whose key is `id`: counts of rows created, changed and refused.

    headers: name in the file (any case) to column. Columns of the file that it doesn't list are refused. Rows without a
    part of the natural key are refused one by one; of rows with the same key the last counts.
    """
    spark = table.spark
    first = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path).columns
    by_name = {k.lower(): v for k, v in headers.items()}
    if unknown := [h for h in first if h.strip().lower() not in by_name]:
        raise ValueError(f"unknown columns: {unknown}")
    kinds = {f.name: f.dataType for f in table.schema}
    raw = catalogue_csv(spark, path, StructType.fromDDL(", ".join(f"`{h}` string" for h in first)), sep)
    rows = raw.select(F.monotonically_increasing_id().alias("row_"), *(F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).try_cast(kinds[by_name[h.strip().lower()]]).alias(by_name[h.strip().lower()]) for h in first))
    whole = rows.where(" and ".join(f"`{n}` is not null" for n in natural)).withColumn("id", natural_id(*natural))
    own = [c for c in whole.columns if c not in ("row_", "id")]
    last = whole.groupBy("id").agg(F.max_by(F.struct(*own), "row_").alias("r")).select("id", "r.*")
    counts = {"refused": rows.count() - whole.count(), "created": last.join(table.read(), "id", "left_anti").count()}
    changed = last.count() - counts["created"]
    table.upsert(last)
    return counts | {"changed": changed}


# ------------------------------------------------------------------------------------ queries


@catalog.query("table_insert", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def table_insert(spark: SparkSession, d: str) -> DataFrame:
    """All customers inserted in two parts, read back from the last commit."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    table = KeyedTable(spark, shared_folder(spark), "c_custkey long, c_name string, c_acctbal double", ["c_custkey"])
    table.insert(c.where("c_acctbal < 3000"))
    table.insert(c.where("c_acctbal >= 3000"))
    return table.read()


@catalog.query("table_update", """
SELECT c_custkey, CASE WHEN n IS NULL THEN c_name ELSE c_name || ' (' || n || ')' END AS c_name, CASE WHEN c_acctbal > 9000 THEN NULL ELSE coalesce(spent, c_acctbal) END AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey
WHERE c_mktsegment <> 'FURNITURE' UNION ALL SELECT -1 - r_regionkey, r_name, NULL FROM region""")
def table_update(spark: SparkSession, d: str) -> DataFrame:
    """Customers updated from their orders, some values cleared, a segment deleted, regions upserted."""
    c = load(spark, d, "customer")
    table = KeyedTable(spark, shared_folder(spark), "c_custkey long, c_name string, balance double", ["c_custkey"], 8)
    table.insert(c.select("c_custkey", "c_name", F.col("c_acctbal").alias("balance")))
    done = load(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("balance"))
    table.update(done.join(c, "c_custkey").select("c_custkey", F.concat("c_name", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("c_name"), "balance"))
    table.update(c.where("c_acctbal > 9000").select("c_custkey", F.lit(None).cast("double").alias("balance")), clear=("balance",))
    table.delete(c.where("c_mktsegment = 'FURNITURE'"))
    table.upsert(load(spark, d, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("c_custkey"), F.col("r_name").alias("c_name")))
    return table.read()


@catalog.query("catalogue_import", """
WITH r AS (SELECT p_brand, p_name, p_type, max(p_partkey) AS k FROM part GROUP BY ALL)
SELECT substr(sha1(lower(p.p_brand) || '|' || lower(p.p_name) || '|' || lower(p.p_type)), 1, 16) AS id, p.p_brand AS brand, p.p_name AS model, p.p_type AS trim, p.p_size AS size, round(p.p_retailprice, 2) AS price, p.p_name || ', "' || p.p_type || '"' || chr(10) || 'new' AS note FROM part p JOIN r ON r.k = p.p_partkey""")
def catalogue_import(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as a file with quoted fields and imported twice by brand, model and trim."""
    folder = shared_folder(spark)
    p = load(spark, d, "part").orderBy("p_partkey").coalesce(1)
    text = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\nnew'))
    file = p.select(F.col("p_name").alias("Model"), F.col("p_brand").alias("BRAND"), F.concat(F.lit("  "), "p_type").alias("Trim level"), F.col("p_size").cast("string").alias("size"), F.round("p_retailprice", 2).cast("string").alias("List price"), text.alias("note"))
    file.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/file")
    table = KeyedTable(spark, f"{folder}/table", "id string, brand string, model string, trim string, size int, price double, note string", ["id"])
    headers = {"brand": "brand", "model": "model", "trim level": "trim", "size": "size", "list price": "price", "note": "note"}
    import_catalogue(table, f"{folder}/file", headers, ("brand", "model", "trim"))
    import_catalogue(table, f"{folder}/file", headers, ("brand", "model", "trim"))
    return table.read()
