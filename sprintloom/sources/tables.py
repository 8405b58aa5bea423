"""Stored tables: plain Parquet folders, divided by month, written by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.expressions import sort_if
from ..operators import maintenance as m
from ..schemas import COLUMN_DEFAULTS, STATES, TABLE_KEYS, TABLE_ORDER, TABLES

PART = "part"
# Texts are most of what is stored, and every batch is written twice.
CODEC = "zstd"


def month_of(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("m"), F.date_format(column, "yyyy-MM")), F.lit("none"))


# How a table is divided; one that is not listed is a single part. The month of an entry never
# changes, so a batch concerns the months it has rows of. An issue stays in the part it came to first even if its
# creation time is corrected later; what is kept per issue lies in that part too.
PARTS: dict[str, Callable[[], Column]] = {
    "issues": lambda: month_of("created"),
    "issue_comments": lambda: month_of("created"),
    "issue_changelog": lambda: month_of("created"),
    "weekly_sums": lambda: month_of("week_start"),
    "memberships": lambda: F.coalesce(F.col(PART), F.lit("none")),
    "completion_times": lambda: F.coalesce(F.col(PART), F.lit("none")),
}
STAYING = ("issues",)
# Tables that are read out of what a batch can be added to.
VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "weekly_metrics": ("weekly_sums", m.weekly_of_sums),
    "sprint_issues": ("memberships", lambda state: state.select("sprint_name", "issue_key")),
    "completions": ("completion_times", m.completions_of_times),
}


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def all_issues(issues: DataFrame, ordered: bool = True) -> DataFrame:
    """Every issue, newest first; the key splits a day that holds very many issues."""
    return sort_if(issues, ordered, F.desc_nulls_last("created"), "key")


class TableStore:
    """Tables below one root, a folder of Parquet parts each, for one writer at a time.

    A batch is staged first: the new content of every part it concerns, of all tables, is written below ``_batch``. Then
    Spark's writer replaces those parts (dynamic partition overwrite). A writer that ends while it stages has
    changed nothing; one that ends while it replaces is made good by ``recover``, which replaces the
    same parts by the same rows once more. So a batch counts once, whenever its writer ends, and as
    merging it again changes nothing, also if it is sent again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ── folders ─────────────────────────────────────────────────────────────────────────────

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        self._fs().delete(self._path(folder), True)

    def parts(self, table: str) -> list[str]:
        return [n.removeprefix(f"{PART}=") for n in self._names(table) if n.startswith(f"{PART}=")]

    # ── reading ─────────────────────────────────────────────────────────────────────────────

    def _schema(self, table: str) -> T.StructType:
        return TABLES[table] if table in TABLES else STATES[table]

    def _columns(self, table: str) -> list[str]:
        """The columns of the stored files, by the footer of one: all files of a table have the same."""
        stored = self.spark.read.parquet(f"{self.root}/{table}").columns if self.parts(table) else self._schema(table).fieldNames()
        return [c for c in self._schema(table).fieldNames() if c in stored]

    def rows_with_part(self, table: str, folder: str | None = None) -> DataFrame:
        """The rows with their ``part``, in today's schema."""
        schema, at = self._schema(table), folder or table
        if not [n for n in self._names(at) if n.startswith(f"{PART}=")]:
            none = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(PART, T.StringType())]))
            return none.filter(F.lit(False))  # so that plans know that it is empty and join nothing with it
        known = T.StructType([*[schema[c] for c in (self._columns(table) if folder is None else schema.fieldNames())], T.StructField(PART, T.StringType())])
        return m.evolve_schema(self.spark.read.schema(known).parquet(f"{self.root}/{at}"), schema, COLUMN_DEFAULTS.get(table, {}))

    def read(self, table: str) -> DataFrame:
        """The stored table in today's schema; an empty typed frame when there is none."""
        if table in VIEWS:
            kept, view = VIEWS[table]
            return view(self.rows_with_part(kept).drop(PART))
        return self.rows_with_part(table).drop(PART)

    # ── writing ─────────────────────────────────────────────────────────────────────────────

    def parted(self, table: str, rows: DataFrame) -> DataFrame:
        """The table's columns and the part of each row."""
        part = PARTS[table]() if table in PARTS else F.lit("all")
        return rows.select(*self._schema(table).fieldNames(), part.alias(PART))

    def commit(self, new: Mapping[str, DataFrame], batch: str | None = None, whole: Collection[str] = ()) -> None:
        """Replace the parts of the tables that the frames, as ``parted`` gives them, have rows of; of the ``whole`` tables
        also those they have no rows of. ``batch`` names the folder it is staged in."""
        self.recover()
        staged = f"_batch/{batch or uuid.uuid4().hex}"
        for table, rows in new.items():
            together = rows.hint("rebalance", F.col(PART))
            together.write.mode("overwrite").option("compression", CODEC).partitionBy(PART).parquet(f"{self.root}/{staged}/{table}")
        # One file that is there or not: from then on the batch counts.
        ready = self.spark.createDataFrame([(t, t in whole) for t in new], "name string, whole boolean")
        ready.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{staged}/ready")
        self._replace(staged)

    def recover(self) -> int:
        """Finish batches that were staged and drop those that were not; returns how many were finished."""
        finished = 0
        for name in self._names("_batch"):
            if any(n.startswith("part-") for n in self._names(f"_batch/{name}/ready")):
                self._replace(f"_batch/{name}")
                finished += 1
            else:
                self._delete(f"_batch/{name}")
        return finished

    def _replace(self, staged: str) -> None:
        for row in self.spark.read.schema("name string, whole boolean").parquet(f"{self.root}/{staged}/ready").collect():
            self._replace_parts(row.name, f"{staged}/{row.name}", row.whole)
        self._delete(f"{staged}/ready")
        self._delete(staged)

    def _replace_parts(self, table: str, folder: str, whole: bool) -> None:
        """Rows of a part come together when they are staged, and a large part spreads over several tasks and
        files. Row order inside a file serves data skipping."""
        given = {n.removeprefix(f"{PART}=") for n in self._names(folder) if n.startswith(f"{PART}=")}
        if given:
            rows = self.rows_with_part(table, folder).sortWithinPartitions(PART, *TABLE_ORDER.get(table, ()))
            rows.write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.root}/{table}")
        for part in set(self.parts(table)) - given if whole else ():
            self._delete(f"{table}/{PART}={part}")

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Replace a whole table and return it. The frame may read the table it replaces."""
        self.commit({table: self.parted(table, rows)}, whole=[table])
        return self.read(table)

    def merged(self, table: str, updates: DataFrame, order_by: Sequence[str | Column] | None = None) -> tuple[DataFrame, DataFrame]:
        """The new content of the parts that a batch changes, and the batch's ``merge_pairs``, whose rows have their part.

        Only keys are read of parts the batch has no rows of, and those only of tables whose rows stay in their part. A
        batch that states what is stored changes no part.
        """
        keys, columns = list(TABLE_KEYS[table]), self._schema(table).fieldNames()
        stored, parts = self.rows_with_part(table), set(self.parts(table))
        among = lambda names: stored.filter(F.col(PART).isin(names) if names else F.lit(False))
        batch = self.parted(table, self._newest(table, updates.select(*columns), keys, order_by))
        if table in STAYING and parts:
            batch = self.written(batch, f"{table}-newest")
            known = stored.join(batch.select(*keys), keys, "left_semi").select(*keys, F.col(PART).alias("_known"))
            batch = batch.join(known, keys, "left").select(*columns, F.coalesce("_known", PART).alias(PART))
        batch = self.written(batch, f"{table}-batch")
        # Months of the calendar: short lists whatever the batch.
        touched = [r[0] for r in batch.select(PART).distinct().collect()]
        near = sorted(parts.intersection(touched))
        pairs = m.merge_pairs(among(near), batch, keys, order_by)
        if near:  # else the pairs are the batch's own rows, all new, and need not be written once more
            pairs = self.written(pairs, f"{table}-pairs")
            changed = pairs.filter(~F.col("old").eqNullSafe(F.col("new")))
            touched = [r[0] for r in changed.select(f"new.{PART}").distinct().collect()]
        if touched and self._columns(table) != columns:  # files of an older schema are written anew together
            touched += self.parts(table)
        standing = among([p for p in touched if p in parts]).join(batch.select(*keys), keys, "left_anti")
        given = pairs.select("new.*").filter(F.col(PART).isin(touched))
        return standing.select(*columns, PART).unionByName(given), pairs

    def _newest(self, table: str, rows: DataFrame, keys: list[str], order_by: Sequence[str | Column] | None) -> DataFrame:
        """``newest_per_key``, for which only rows whose key comes more than once are sorted and shuffled.

        Which keys do is counted first, without the other columns, and written, so that Spark broadcasts a short list.
        """
        whole = rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
        repeated = self.written(whole.groupBy(*keys).count().filter("count > 1").select(*keys), f"{table}-repeated")
        if repeated.isEmpty():
            return whole
        several = m.newest_per_key(whole.join(repeated, keys, "left_semi"), keys, order_by)
        return whole.join(repeated, keys, "left_anti").select(*rows.columns).unionByName(several)

    def changed(self, table: str, delta: DataFrame, add: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The new content of the parts of a derived table that ``delta``, with a column ``part``, concerns."""
        delta = self.written(delta, f"{table}-delta")
        touched = [r[0] for r in delta.select(PART).distinct().collect()]
        old = self.rows_with_part(table).filter(F.col(PART).isin(touched))
        return add(old, delta)

    def upsert(self, table: str, updates: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
        """Merge a batch (see ``maintenance.upsert``) and return the stored table."""
        rows, _ = self.merged(table, updates, order_by)
        self.commit({table: rows})
        return self.read(table)

    # ── upkeep ──────────────────────────────────────────────────────────────────────────────

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """Write an intermediate result below the root and read it back: short lineage, no lost blocks."""
        path = f"{self.root}/_work/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_work(self) -> None:
        """Delete all intermediate results, when no run of this store is under way."""
        self._delete("_work")
