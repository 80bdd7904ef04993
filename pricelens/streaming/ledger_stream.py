"""The ledger as a stream: every new snapshot file advances the state.

A micro-batch may hold many snapshot days, a part of one day, a day that was applied before or an
older one; after each batch the state is what ``ledger.rebuild`` gives over all rows so far.
Ids whose rows are newer than all they had are merged into their summary. The others are
summarised again from the rows kept of all batches; of rows at one (id, day, place) the
one delivered last counts, so a file delivered twice changes nothing.

Ids are dealt over ``buckets`` by a hash. The log of rows and the summaries are stored by bucket: a batch reads
and rewrites the summaries of the buckets that its ids are in, and takes earlier rows of late ids from
those ids' buckets alone. What changes with every day for every listing, its status, is not
stored: it follows from summary, calendar and probes when the state is read.

Versions are written per batch id, so a replayed batch overwrites its own and nothing else: results
are exactly once. The summaries of a bucket at version N are those of the newest version up to N that
has it; older ones that no replay of the last batch reads are deleted.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricelens import fixed_values as fv
from pricelens.operators import ledger


def snapshot_stream(
    spark: SparkSession, path: str, schema: str, max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Snapshot Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


#: Buckets of ids. Fixed for the life of a ledger; the driver handles one number for each, never ids.
BUCKETS = 16


class LedgerStream:
    """Applies snapshot micro-batches to a versioned ledger table. ``signals``: all probes so far."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fields: list[str] | None = None,
        withdraw_after: int = fv.WITHDRAW_AFTER_DAYS,
        signals: DataFrame | None = None,
        buckets: int = BUCKETS,
    ):
        self.spark = spark
        self.root = root
        self.fields = fv.SNAPSHOT_FIELDS if fields is None else fields
        self.withdraw_after = withdraw_after
        self.signals = signals
        self.buckets = buckets

    def _path(self, table: str, version: int) -> str:
        return os.path.join(self.root, table, f"version={version}")

    def _written(self, df: DataFrame, table: str, version: int) -> DataFrame:
        path = self._path(table, version)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _dealt(self, df: DataFrame, table: str, version: int) -> None:
        """``df`` by buckets. A rebalance and not a repartition, so a crowded bucket is written by many tasks."""
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))
        dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(table, version))

    def _heads(self, version: int) -> dict[str, int]:
        """For each bucket that has summaries, the version that holds them."""
        heads: dict[str, int] = {}
        for name in self._names("summaries"):
            held = int(name.removeprefix("version="))
            if held <= version:
                heads |= {b: max(held, heads.get(b, -1)) for b in self._names("summaries", held)}
        return heads

    def _summaries(self, heads: dict[str, int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self._path('summaries', v)}/{b}" for b, v in sorted(heads.items())])

    def _days(self, version: int) -> DataFrame:
        """(snapshot_date, n, late, version): the snapshot days of all batches up to ``version``."""
        schema = "snapshot_date date, n long, late boolean, version long"
        return self.spark.read.schema(schema).parquet(os.path.join(self.root, "days")).where(F.col("version") <= version)

    def _all_rows(self, ids: DataFrame, schema: StructType, touched: list[str], version: int) -> DataFrame:
        """The rows of ``ids`` in all batches up to ``version``, read from the ``touched`` buckets."""
        dealt = StructType(list(schema.fields)).add("version", "long").add("bucket", "integer")
        kept = self.spark.read.schema(dealt).parquet(os.path.join(self.root, "rows"))
        theirs = kept.where((F.col("version") <= version) & F.col("bucket").isin([int(b.removeprefix("bucket=")) for b in touched]))
        place = ["id", "snapshot_date", "pos"]
        values = [c for c in schema.names if c not in place]
        last = theirs.join(ids, "id", "left_semi").groupBy(*place).agg(F.max_by(F.struct(*values), "version").alias("v"))
        return last.select(*place, "v.*").select(*schema.names)

    def apply(self, batch: DataFrame, version: int) -> None:
        """One micro-batch: version N is version N - 1 with the batch's rows."""
        self._dealt(batch, "rows", version)
        touched = self._names("rows", version)
        rows = self.spark.read.schema(batch.schema).parquet(self._path("rows", version)).drop("bucket")
        newest = self._days(version - 1).agg(F.max("snapshot_date")).first()[0] if version > 0 else None
        late = F.coalesce(F.col("snapshot_date") <= F.lit(newest).cast("date"), F.lit(False))
        # One row per snapshot day of the batch.
        days = rows.groupBy("snapshot_date").agg(F.count("*").alias("n")).withColumn("late", late)
        self._written(days.coalesce(1), "days", version)
        heads = {b: v for b, v in self._heads(version - 1).items() if b in touched}
        state = self._summaries(heads) if heads else None
        if state is not None:
            since = rows.groupBy("id").agg(F.min("snapshot_date").alias("since"))
            behind = since.join(state.select("id", "last_seen"), "id").where("since <= last_seen").select("id")
            behind = self._written(behind, "behind", version)
            if not behind.isEmpty():
                # One summary of both: an id that is behind comes with all its rows and meets no state.
                theirs = self._all_rows(behind, batch.schema, touched, version)
                rows = self._written(rows.join(behind, "id", "left_anti").unionByName(theirs), "taken", version)
                state = state.join(behind, "id", "left_anti")
        fresh = ledger.summarise(rows, self.fields)
        self._dealt(fresh if state is None else ledger.merge_summaries(state, fresh, self.fields), "summaries", version)
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Deletes what neither this version nor a replay of it reads."""
        for table in ("behind", "taken"):
            self._delete(self._path(table, version))
        needed = set(self._heads(version).items()) | set(self._heads(version - 1).items())
        for bucket, head in set(self._heads(version - 2).items()) - needed:
            self._delete(f"{self._path('summaries', head)}/{bucket}")

    def _names(self, table: str, version: int | None = None) -> list[str]:
        """The folders of a table (one per version) or of a version of it (one per bucket)."""
        files, path = self._store(os.path.join(self.root, table) if version is None else self._path(table, version))
        found = files.listStatus(path) if files.exists(path) else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName())

    def _delete(self, path: str) -> None:
        files, target = self._store(path)
        files.delete(target, True)

    def _store(self, path: str):
        """The file system of a path, whatever store the root is in, and the path there."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def start(self, stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = (
            stream.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", os.path.join(self.root, "progress"))
            .queryName("ledger")
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def state(self, version: int) -> DataFrame:
        """The ledger after a batch: its summaries with the status they have at that day."""
        calendar = ledger.snapshot_calendar(self._days(version), self.withdraw_after)
        return ledger.with_status(self._summaries(self._heads(version)), calendar, self.signals)

    def latest(self) -> DataFrame:
        """The state after the newest batch."""
        return self.state(max(int(name.removeprefix("version=")) for name in self._names("summaries")))

    def late_rows(self, version: int) -> DataFrame:
        """(snapshot_date, n): rows of the batch at or before a day that was applied already."""
        return self._days(version).where((F.col("version") == version) & F.col("late")).select("snapshot_date", "n")
