"""Versioned tables on plain Parquet.

Data is written first, under its snapshot id; one small commit file makes it
visible. Readers resolve the current snapshot once and then read only its chain
of partitions: a whole one and, newest last, what later snapshots changed. A
chain of ``COMPACT_AFTER`` partitions is followed by a whole one. Rows lie in
order of project with bloom filters, so a question about a few projects skips
the files that do not hold them. One writer at a time is assumed, as a streaming
query gives.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelens import schemas
from estatelens.session import stored

#: Partitions of one chain.
COMPACT_AFTER = 16
#: Least projects of a file, where there is more than one.
RANGE_KEYS = 1000
TABLES = {"profiles": schemas.PROFILES, "catalog": schemas.CATALOG, "skips": schemas.SKIPS}


def upsert_last(writes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write per key, by ``order``; partial aggregation before the shuffle."""
    rest = [c for c in writes.columns if c not in keys and c != order]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("x")
    return writes.groupBy(*keys).agg(last).select(*keys, "x.*")


def carry_forward(parent: DataFrame, changed: DataFrame, key: str = "project_id") -> DataFrame:
    """The parent's rows, those of changed projects replaced."""
    return parent.join(changed.select(key), key, "left_anti").unionByName(changed)


def in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` laid in ranges of a whole-number key, which alone is read to find the ranges.

    Spark's own range partitioning works out whole rows twice, once for a sample
    of their keys. Few keys make few ranges.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = F.percentile_approx(key, [n / most for n in range(1, most)] or [0.5], 100 * most)
    told = rows.select(key).distinct().agg(F.count(key).alias("keys"), steps.alias("cuts")).first()
    count = max(1, min(most, told["keys"] // RANGE_KEYS))
    cuts = told["cuts"][most // count - 1 :: most // count][: count - 1] if count > 1 else []
    place = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col(key)))
    return rows.repartitionById(len(cuts) + 1, place)


def current_id(commits: DataFrame) -> DataFrame:
    """Id of the last committed snapshot (not the greatest id); no row before the first commit."""
    done = commits.filter(F.col("status") == "completed")
    return (
        done.agg(F.max_by("snapshot_id", "commit_seq").alias("snapshot_id")).filter(F.col("snapshot_id").isNotNull())
    )


def current_rows(table: DataFrame, commits: DataFrame) -> DataFrame:
    """N5 as one plan: rows of the current snapshot (the id is a one-row broadcast)."""
    return table.join(F.broadcast(current_id(commits)), "snapshot_id", "left_semi")


def snapshot_metadata(commits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Start, end, trigger and the map of project to commit of every snapshot.

    The map holds one entry per project of the snapshot by definition.
    """
    shas = profiles.groupBy("snapshot_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("project_id", "commit_sha")))).alias("commit_sha_by_project")
    )
    return (
        commits.join(shas, "snapshot_id", "left")
        .select("snapshot_id", "status", "trigger", "started_at", "completed_at", "commit_sha_by_project")
    )


def snapshot_summary(commits: DataFrame, profiles: DataFrame) -> DataFrame:
    """N6 of fixed size: start, end and trigger of every snapshot, how many projects it has, and a digest of their commits.

    The digest is a sum over projects, so parts add up in any order and two
    snapshots with equal digests hold the same commits. The commits themselves
    are rows of ``profiles``; :func:`snapshot_metadata` nests those asked for.
    """
    code = F.conv(F.substring(F.md5(F.concat_ws("=", F.col("project_id").cast("string"), "commit_sha")), 1, 12), 16, 10).cast("decimal(15,0)")
    sums = profiles.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_projects"), (F.sum(code) % F.lit(10**15)).cast("long").alias("commits_digest"))
    return (
        commits.join(sums, "snapshot_id", "left")
        .select("snapshot_id", "status", "trigger", "started_at", "completed_at", F.coalesce("n_projects", F.lit(0)).alias("n_projects"), F.coalesce("commits_digest", F.lit(0)).alias("commits_digest"))
    )


class SnapshotStore:
    """Snapshot tables below one folder of a file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark = spark
        self.root = root.rstrip("/")
        self.compact_after = compact_after
        self._chains: dict[int, list[int]] = {}  # fixed once a snapshot has begun

    # --- commit log -------------------------------------------------------

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def commits(self) -> DataFrame:
        """Latest state of every snapshot: one row per id."""
        path = f"{self.root}/commits"
        if not self._exists(path):
            return self.spark.createDataFrame([], schemas.COMMITS)
        log = self.spark.read.schema(schemas.COMMITS).parquet(path)
        return upsert_last(log, ["snapshot_id"], "commit_seq").join(
            log.groupBy("snapshot_id").agg(F.max("commit_seq").alias("commit_seq")), "snapshot_id"
        )

    def _append(self, row: dict) -> None:
        """One log row as one file: the rename of that file is the commit."""
        last = self.commits().agg(F.max("commit_seq").alias("n")).first()["n"]
        full = {f.name: row.get(f.name) for f in schemas.COMMITS} | {"commit_seq": (last or 0) + 1}
        data = [tuple(full[f.name] for f in schemas.COMMITS)]
        self.spark.createDataFrame(data, schemas.COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def _state(self, snapshot_id: int) -> dict:
        row = self.commits().filter(F.col("snapshot_id") == snapshot_id).first()
        if row is None:
            raise ValueError(f"no snapshot {snapshot_id}")
        if row["status"] != "in_progress":
            raise ValueError(f"snapshot {snapshot_id} is {row['status']}")
        return row.asDict()

    # --- N1, N4 -----------------------------------------------------------

    def begin_snapshot(self, trigger: str = "full", parent: int | None = None, batch_key: str | None = None) -> int:
        """A new id in progress. A parent is required for, and only for, ``single_project``; its chain goes on until it is full."""
        if (trigger == "single_project") != (parent is not None):
            raise ValueError("a parent goes with single_project, and only with it")
        top = self.commits().agg(F.max("snapshot_id").alias("n")).first()["n"]
        new_id = (top or 0) + 1
        before = [] if parent is None else self.chain(parent)
        self._append(
            {
                "snapshot_id": new_id, "status": "in_progress", "trigger": trigger, "parent_snapshot_id": parent,
                "started_at": datetime.now(timezone.utc), "batch_key": batch_key,
                "chain": [*(before if len(before) < self.compact_after else []), new_id],
            }
        )
        return new_id

    def commit(self, snapshot_id: int, counts: dict[str, int] | None = None) -> None:
        """Completed, and current from now on, with A8's counts of the refresh."""
        state = self._state(snapshot_id)
        self._append(state | {"status": "completed", "completed_at": datetime.now(timezone.utc)} | (counts or {}))

    def abort(self, snapshot_id: int) -> None:
        """Failed; the current snapshot stays and the rows are kept."""
        state = self._state(snapshot_id)
        self._append(state | {"status": "failed", "completed_at": datetime.now(timezone.utc)})

    def completed_batch(self, batch_key: str) -> int | None:
        """Snapshot that a batch already published, if any."""
        row = self.commits().filter((F.col("batch_key") == batch_key) & (F.col("status") == "completed")).first()
        return row["snapshot_id"] if row else None

    def chain(self, snapshot_id: int) -> list[int]:
        """The snapshots whose partitions make this one, the whole one first; at most ``compact_after``."""
        if snapshot_id not in self._chains:
            row = self.commits().filter(F.col("snapshot_id") == snapshot_id).first()
            if row is None:
                return [snapshot_id]
            self._chains[snapshot_id] = list(row["chain"] or [snapshot_id])
        return self._chains[snapshot_id]

    # --- S13, N5 ----------------------------------------------------------

    def write(self, table: str, snapshot_id: int, rows: DataFrame, schema: StructType | None = None, placed: bool = False) -> int:
        """The rows of one snapshot, replacing an earlier attempt at the same snapshot; in order of their first column.

        Returns how many there are, counted by the write itself. ``placed``
        rows are written where they lie: they come in ranges of that column
        already, as from a table of this store, or are only ever read whole.
        """
        fields = (schema or TABLES[table]).fieldNames()
        key, counted = fields[0], Observation()
        kept = rows.select(*fields)
        (
            (kept if placed else in_ranges(kept, key))
            .sortWithinPartitions(key)
            .observe(counted, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite")
            .option(f"parquet.bloom.filter.enabled#{key}", "true")
            .parquet(f"{self.root}/{table}/snapshot_id={snapshot_id}")
        )
        return counted.get["rows"]

    def written(self, table: str, snapshot_id: int, schema: StructType | None = None) -> DataFrame:
        """What one snapshot wrote: all its rows, or those it changed."""
        path, schema = f"{self.root}/{table}/snapshot_id={snapshot_id}", schema or TABLES[table]
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def newest(self, table: str, chain: list[int], schema: StructType | None = None, changed_by: str | None = None) -> DataFrame:
        """N2, read: the rows of a chain, each project's from the last snapshot that changed it.

        ``changed_by`` names the table whose rows say which projects a snapshot
        changed, where a project may have many rows or none.
        """
        base = self.written(table, chain[0], schema)
        if len(chain) == 1:
            return base
        deltas = [self.written(table, i, schema).withColumn("_n", F.lit(n)) for n, i in enumerate(chain) if n]
        told = [self.written(changed_by or table, i).select("project_id", F.lit(n).alias("_n")) for n, i in enumerate(chain) if n]
        last = reduce(DataFrame.unionByName, told).groupBy("project_id").agg(F.max("_n").alias("_n"))
        changed = reduce(DataFrame.unionByName, deltas).join(last, ["project_id", "_n"], "left_semi").drop("_n")
        return base.join(last.select("project_id"), "project_id", "left_anti").unionByName(changed).select(*base.columns)

    def snapshot(self, table: str, snapshot_id: int) -> DataFrame:
        """All rows of a snapshot; skips are those of its own refresh."""
        return self.newest(table, [snapshot_id] if table == "skips" else self.chain(snapshot_id))

    def pointer(self) -> int | None:
        """The current snapshot id, resolved once by the caller for all tables it reads."""
        row = current_id(self.commits()).first()
        return row["snapshot_id"] if row else None

    def current(self, table: str, pointer: int | None = None) -> DataFrame:
        """Rows of the current snapshot; none before the first commit."""
        pointer = self.pointer() if pointer is None else pointer
        if pointer is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.snapshot(table, pointer)

    # --- N2 ---------------------------------------------------------------

    def copy_forward(self, parent: int, snapshot_id: int, profiles: DataFrame, catalog: DataFrame, skips: DataFrame) -> dict[str, int]:
        """The changed projects only, read over the parent's chain; a snapshot that begins a chain gets all rows.

        A skipped project keeps its old profile. Returns A8: profiles written by
        the refresh (``profiles_written``, without carried ones) and projects ``skipped``.
        """
        whole, written = len(self.chain(snapshot_id)) == 1, 0
        for table, rows in (("catalog", catalog), ("profiles", profiles)):
            if whole:
                before, rows = self.snapshot(table, parent), stored(rows)
                carried = before.join(rows.select("project_id"), "project_id", "left_anti")
                written = self.write(table, snapshot_id, carry_forward(before, rows)) - carried.count()
            else:
                written = self.write(table, snapshot_id, rows)
        return {"profiles_written": written, "skipped": self.write("skips", snapshot_id, skips)}
