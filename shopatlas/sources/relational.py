"""Relational databases over JDBC: partitioned scans, and loads that replace a table as a whole."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import storage

BATCH_ROWS = 500  # fixed value: rows sent in one insert
RENAME = "RENAME TABLE {old} TO {new}"  # as Derby and MySQL spell it; PostgreSQL: ALTER TABLE {old} RENAME TO {new}
ROWS_A_FILE = 500_000  # of an unloaded table, about
NULL = "\0"


def _is_apart(spark: SparkSession, url: str) -> bool:
    """Whether executors can't reach the database: one inside the driver's process, on a cluster."""
    embedded = url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")
    return embedded and spark.sparkContext.master.split("[")[0] != "local"


def _copy_in(rows: DataFrame, url: str, table: str) -> None:
    """Rows into an empty table of a database inside the driver's process: tasks write CSV files, the database's bulk import takes one after another."""
    spark, folder = rows.sparkSession, storage.fresh_path(rows.sparkSession, "load")
    cell = lambda c, t: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "string" else F.col(c).cast("string")
    line = F.array_join(F.array(*(cell(f"`{c}`", t) for c, t in rows.dtypes)), ",", "")
    rows.select(line.alias("value")).write.text(folder)
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(folder)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with tempfile.TemporaryDirectory() as own:
        for part in sorted(f.getPath().toString() for f in files.listStatus(source)):
            if part.endswith(".txt"):
                path = f"{own}/rows.csv"
                files.copyToLocalFile(False, jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path), True)
                _statements(spark, url, [f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{path}', ',', '\"', 'UTF-8', 0)"])
                os.remove(path)


def _copy_out(spark: SparkSession, url: str, table: str, key: str, low: int | None, high: int | None, parts: int, rows: DataFrame) -> DataFrame:
    """A table of a database inside the driver's process: exported in ranges of the key to CSV files, which tasks read."""
    folder, jvm = storage.fresh_path(spark, "unload"), spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    parts = max(parts, -(-_one_row(spark, url, f"SELECT count(*) FROM {table}")[0] // ROWS_A_FILE))
    cuts = [] if low is None else sorted({low + (high + 1 - low) * k // parts for k in range(1, parts)} - {low})
    quoted = f'"{key}"'
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    ranges = [f"{quoted} < {cuts[0]} OR {quoted} IS NULL", *(f"{quoted} >= {a} AND {quoted} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{quoted} >= {cuts[-1]}"] if cuts else ["1 = 1"]
    with tempfile.TemporaryDirectory() as own:
        for k, where in enumerate(ranges):
            path = f"{own}/part-{k:05d}.csv"
            _statements(spark, url, [f"CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY('SELECT {columns} FROM {table} WHERE {where}', '{path}', ',', '\"', 'UTF-8')"])
            files.copyFromLocalFile(True, jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder))
    return spark.read.schema(rows.schema).options(multiLine="true", quote='"', escape='"', nullValue=NULL, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", mode="FAILFAST").csv(folder)


def scan_table(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """All rows of a table, read in ``parts`` ranges of a numeric key; filters and columns go to the database.

    The key's least and largest value come from the database; rows beyond them that arrive
    meanwhile, and rows without a key, belong to the outer ranges, so none is lost.  On a cluster
    a database inside the driver's process exports the ranges to the shared folder instead.
    """
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    bounds = f"SELECT min({quoted}) AS low, max({quoted}) AS high FROM {table}"
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if _is_apart(spark, url):
        return _copy_out(spark, url, table, key, *_one_row(spark, url, bounds), parts, rows.load())
    low, high = spark.read.format("jdbc").options(url=url, **options).option("query", bounds).load().first()
    if low is not None:
        rows = rows.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    return rows.load()


def _statements(spark: SparkSession, url: str, statements: list[str], missing_ok: int = 0) -> None:
    """Run statements in one transaction; the first ``missing_ok`` of them may fail."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        for k, sql in enumerate(statements):
            statement = connection.createStatement()
            try:
                statement.executeUpdate(sql)
            except Exception:
                if k >= missing_ok:
                    connection.rollback()
                    raise
            finally:
                statement.close()
        connection.commit()
    finally:
        connection.close()


def _one_row(spark: SparkSession, url: str, sql: str) -> list:
    """The numbers of a query's only row, asked by the driver itself."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.createStatement().executeQuery(sql)
        found.next()
        return [None if (x := found.getObject(k + 1)) is None else int(x) for k in range(found.getMetaData().getColumnCount())]
    finally:
        connection.close()


def load_table(rows: DataFrame, url: str, table: str, batch_rows: int = BATCH_ROWS, rename: str = RENAME, **options: str) -> int:
    """Replace a table by ``rows``; their number.

    Tasks insert in batches into a staging table.  Only when all have ended is it counted and
    takes the table's place, in one transaction; a load that fails before leaves the table as it was.
    On a cluster a database inside the driver's process imports the files that tasks write.
    """
    spark, staging = rows.sparkSession, f"{table}_staging"
    _statements(spark, url, [f"DROP TABLE {staging}"], missing_ok=1)
    apart = _is_apart(spark, url)
    new = rows.where("false") if apart else rows  # the driver makes the table, no task inserts
    new.write.format("jdbc").options(url=url, dbtable=staging, batchsize=str(batch_rows), isolationLevel="READ_COMMITTED", **options).mode("error").save()
    if apart:
        _copy_in(rows, url, staging)
        (n,) = _one_row(spark, url, f"SELECT count(*) FROM {staging}")
    else:
        n = spark.read.format("jdbc").options(url=url, **options).option("query", f"SELECT count(*) AS n FROM {staging}").load().first()[0]
    _statements(spark, url, [f"DROP TABLE {table}", rename.format(old=staging, new=table)], missing_ok=1)
    return int(n)
