"""The ingest as a stream: files of records in, a bucketed snapshot that each batch changes in part; first-seen filtering."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.ingest import KEPT, KEYS, VALUES, ingest
from ..plans.storage import materialise


NAME = "store_name"


def _with_name(df: DataFrame) -> DataFrame:
    """Names are normalised once; all later steps read the column."""
    return df.withColumn(NAME, text.store_name(F.col("name")))


class SnapshotStore:
    """A snapshot in buckets by chain and normalised name (kept as a column); a batch reads and writes only the buckets that it touches.

    A store that a record can match has the record's chain and name, so it lies in the record's
    bucket.  A second table, in buckets by id, says in which bucket each id's row lies: a record
    may rename the row of its own id, which leaves its old bucket.  Each batch writes the buckets
    it changed into folders of its own, then a manifest with the version of every bucket (two rows a
    bucket at most).  The manifest comes last: a batch that failed before it left nothing that is
    read, and is run again over its own folders.  Older versions stay until someone removes them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.columns = [*KEYS, *VALUES, *KEPT]
        self.stored = [*self.columns, NAME]

    def _bucket(self, *columns: Column | str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int").alias("bucket")

    def _by_name(self) -> Column:
        return self._bucket("chain_id", F.coalesce(F.col(NAME), F.lit("")))

    def _versions(self, batch_id: int) -> dict[str, dict[int, int]]:
        """Kind of table to bucket to the batch that wrote it last."""
        out: dict[str, dict[int, int]] = {"rows": {}, "ids": {}}
        try:
            found = self.spark.read.parquet(f"{self.path}/manifest-{batch_id + 1:09d}").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise ValueError(f"the snapshot after batch {batch_id} was never written") from e
        for r in found:
            out[r.kind][r.bucket] = r.version
        return out

    def _load(self, kind: str, versions: dict[int, int], wanted: set[int] | None, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}-{v + 1:09d}/bucket={b}" for b, v in sorted(versions.items()) if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _save(self, kind: str, df: DataFrame, batch_id: int, versions: dict[int, int], touched: set[int]) -> DataFrame:
        """Write the touched buckets anew and read them back; the version map follows.

        A bucket may be all of the table: rebalancing deals a large one over several tasks and files.
        """
        place = f"{self.path}/{kind}-{batch_id + 1:09d}"
        df.hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(place)
        saved = self.spark.read.schema(df.schema).parquet(place)
        written = {r.bucket for r in saved.select("bucket").distinct().collect()}
        for b in touched - written:
            versions.pop(b, None)
        versions.update({b: batch_id for b in written})
        return saved

    def _publish(self, batch_id: int, versions: dict[str, dict[int, int]]) -> None:
        rows = [(kind, b, v) for kind, held in versions.items() for b, v in held.items()]
        self.spark.createDataFrame(rows, "kind string, bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{batch_id + 1:09d}")

    def start(self, snapshot: DataFrame) -> None:
        versions: dict[str, dict[int, int]] = {"rows": {}, "ids": {}}
        rows = self._save("rows", _with_name(snapshot.select(*self.columns)).withColumn("bucket", self._by_name()), -1, versions["rows"], set())
        self._save("ids", rows.select(*KEYS, F.col("bucket").alias("at"), self._bucket(*KEYS)), -1, versions["ids"], set())
        self._publish(-1, versions)

    def _schemas(self, like: DataFrame) -> tuple[str, str]:
        kinds = dict(like.dtypes)
        return ", ".join(f"{c} {kinds[c]}" for c in self.stored), ", ".join(f"{c} {kinds[c]}" for c in KEYS) + ", at int"

    def read(self, batch_id: int) -> DataFrame:
        """The snapshot after this batch."""
        versions = self._versions(batch_id)["rows"]
        paths = [f"{self.path}/rows-{v + 1:09d}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*paths).select(*self.columns)

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """Ingest one batch of records into the buckets that it touches."""
        records = materialise(_with_name(records.select(*self.columns, "ordinal")), "records")
        schema, id_schema = self._schemas(records)
        versions = self._versions(batch_id - 1)
        some = lambda df: {r[0] for r in df.distinct().collect()}  # noqa: E731  (bucket numbers)
        names, ids = some(records.select(self._by_name())), some(records.select(self._bucket(*KEYS)))
        index = self._load("ids", versions["ids"], ids, id_schema)
        if not names >= set(versions["rows"]):  # rows of own ids may lie in others
            own = records.select(*KEYS).distinct()
            names |= some(index.join(own.hint("merge"), KEYS, "left_semi").select("at"))
        held = self._load("rows", versions["rows"], names, schema)
        after = ingest(held, records, NAME).snapshot.select(*self.stored).withColumn("bucket", self._by_name())
        after = self._save("rows", after, batch_id, versions["rows"], names)
        # an id of a touched index bucket is where the rows just written have it, else where it was
        found = after.where(self._bucket(*KEYS).isin(*ids)).select(*KEYS, F.col("bucket").alias("at"), F.lit(1).alias("new"))
        ids_after = index.withColumn("new", F.lit(0)).unionByName(found).groupBy(*KEYS).agg(F.max_by("at", "new").alias("at"))
        self._save("ids", ids_after.select(*KEYS, "at", self._bucket(*KEYS)), batch_id, versions["ids"], ids)
        self._publish(batch_id, versions)


def stream_ingest(records: DataFrame, store: SnapshotStore, checkpoint: str):
    """Start the stream over all records that are there; one writer at a time."""
    return records.writeStream.foreachBatch(lambda df, batch_id: store.apply(df, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_stream(records: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A record passes the first time its keys are seen; with a time column state older than ``delay`` is let go."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else records.dropDuplicates(keys)
