"""The driver's tables seen as issue-tracker tables, as described in FIXTURES.md."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sprintloom import schemas
from sprintloom.functions.expressions import week_start
from sprintloom.operators import maintenance
from sprintloom.session import shared_dir
from sprintloom.sources.raw import read_raw_issues

AS_OF = "2001-08-15"
EPOCH = "1995-01-01"
LANDED_LINES = 200_000


def _window(day: Column) -> Column:
    return F.floor(F.date_diff(day.cast("date"), F.lit(EPOCH).cast("date")) / 14).cast("int")


def _sprint_name(window: Column, odd: Column) -> Column:
    return F.concat(
        F.lit("S"), F.lpad(window.cast("string"), 3, "0"),
        F.when(odd == 0, " ScrumA").otherwise(" ScrumB"))


def _lookup(column: str, names: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for key, name in names.items():
        value = F.when(F.col(column) == key, name).otherwise(value)
    return value


def _land(lines: DataFrame, folder: str) -> None:
    """Documents land compressed. A compressed file is read by one task, so files are kept short."""
    lines.write.option("compression", "lz4").option("maxRecordsPerFile", LANDED_LINES).text(folder)


def rich_document(text: Column) -> Column:
    """A rich-text tree: one paragraph per line, each line cut in two inside an inline node."""
    def node(kind: str, children: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), children.alias("content"))

    def leaf(part: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), part.alias("text"))

    def paragraph(line: Column) -> Column:
        half = F.floor(F.length(line) / 2).cast("int")
        halves = F.array(
            leaf(F.substring(line, F.lit(1), half)),
            leaf(F.substring(line, half + 1, F.length(line))))
        return node("paragraph", F.array(node("emphasis", halves)))

    return node("doc", F.transform(F.split(text, "\n"), paragraph))


class Model:
    """Lazy model tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def issues(self) -> DataFrame:
        """Issues without their description texts (few reports read them)."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        odd, window = cust % 2, _window(F.col("o_orderdate"))
        prefix = (
            F.when(key % 13 == 0, "緊急 ").when(key % 29 == 0, "Hotfix ")
            .when(key % 37 == 0, "バグ ").otherwise(""))
        customer = self.raw("customer").select("c_custkey", "c_mktsegment")
        return self.raw("orders").join(customer, cust == F.col("c_custkey")).select(
            F.concat(F.lit("K-"), key.cast("string")).alias("key"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "AI Board").otherwise("Main Board")
            .alias("board_name"),
            (window * 2 + odd).cast("int").alias("sprint_id"),
            F.when(key % 31 != 0, _sprint_name(window, odd)).alias("sprint_name"),
            F.concat(prefix, F.lit("order "), key.cast("string")).alias("summary"),
            F.when(cust % 23 != 0,
                   F.concat(F.lit("dev"), F.lpad((cust % 40).cast("string"), 2, "0")))
            .alias("assignee"),
            (F.floor(F.col("o_totalprice") / 25000) / 2).cast("double").alias("reported_sp"),
            _lookup("o_orderstatus", {"F": "Done", "O": "In Progress", "P": "To Do"}).alias("status"),
            _lookup("o_orderstatus", {"F": "完了", "O": "進行中", "P": "To Do"}).alias("status_category"),
            _lookup("o_orderpriority", {
                "1-URGENT": "Highest", "2-HIGH": "High", "3-MEDIUM": "Medium",
                "4-NOT SPECIFIED": "Low", "5-LOW": "Lowest"}).alias("priority"),
            F.when(key % 11 == 0, "Bug").otherwise("Story").alias("issuetype"),
            F.when(F.col("o_orderstatus") == "F", "Done").alias("resolution"),
            (key % 17 == 0).alias("flagged"),
            F.col("o_orderdate").alias("created"),
            (F.col("o_orderdate") + F.make_dt_interval(days=(key % 20).cast("int"))).alias("updated"),
        )

    @cached_property
    def described_issues(self) -> DataFrame:
        texts = self.raw("documents").select(
            F.concat(F.lit("K-"), F.col("doc_id").cast("string")).alias("key"),
            F.col("text").alias("description"))
        return self.issues.join(texts, "key", "left").select(*schemas.ISSUES.fieldNames())

    @cached_property
    def changelog(self) -> DataFrame:
        closes = F.col("l_linestatus") == "F"
        window, odd = _window(F.col("l_shipdate")), F.col("l_suppkey") % 2
        now, after = _sprint_name(window, odd), _sprint_name(window + 1, odd)
        parts = [F.concat(F.lit("K-"), F.col("l_orderkey").cast("string"))] + [
            F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")
        ] + [F.col("l_quantity").cast("int").cast("string")]
        return self.raw("lineitem").select(
            F.concat_ws("_", *parts).alias("id"),
            parts[0].alias("issue_key"),
            F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("author"),
            F.when(closes, "status").otherwise("Sprint").alias("field"),
            F.when(closes, "To Do").otherwise(now).alias("from_string"),
            F.when(closes, _lookup("l_returnflag", {"A": "Done", "R": "完了", "N": "In Progress"}))
            .otherwise(F.concat(now, F.lit(", "), after)).alias("to_string"),
            F.col("l_shipdate").alias("created"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        return self.raw("conversations").select(
            F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.concat(F.lit("K-"), F.col("conv_id").cast("string")).alias("issue_key"),
            F.col("role").alias("author"),
            F.col("text").alias("body"),
            (F.lit("2024-01-01").cast("timestamp_ntz")
             + F.make_dt_interval(hours=F.col("turn").cast("int"))).alias("created"),
        )

    @cached_property
    def long_comments(self) -> DataFrame:
        """The change history as comments on three issues."""
        return self.changelog.select(
            "id", F.concat(F.lit("K-"), (F.length("id") % 3 + 1).cast("string")).alias("issue_key"),
            "author", F.col("to_string").alias("body"), "created")

    @cached_property
    def _sprint_ids(self) -> DataFrame:
        # Sprint windows follow from the order's own columns, so the customer side is not needed.
        odd, window = F.col("o_custkey") % 2, _window(F.col("o_orderdate"))
        return self.raw("orders").select((window * 2 + odd).cast("int").alias("sprint_id")).distinct()

    @cached_property
    def sprints(self) -> DataFrame:
        n = F.floor(F.col("sprint_id") / 2).cast("int")
        snapshot = F.when(F.col("sprint_id") % 3 == 0, 100.0)
        return self._sprint_ids.select(
            "sprint_id",
            F.lit("Main Board").alias("board_name"),
            _sprint_name(n, F.col("sprint_id") % 2).alias("sprint_name"),
            F.when(n >= 171, "future").when(n >= 169, "active").otherwise("closed").alias("state"),
            F.lit(AS_OF).cast("timestamp_ntz").alias("synced_at"),
            snapshot.alias("planned_sp_snapshot"),
            F.when(snapshot.isNotNull(), F.date_add(F.lit(EPOCH).cast("date"), n * 14))
            .cast("timestamp_ntz").alias("snapshot_created_at"),
        )

    @cached_property
    def metadata(self) -> DataFrame:
        n = F.floor(F.col("sprint_id") / 2).cast("int")
        start = F.date_add(F.lit(EPOCH).cast("date"), n * 14)
        end = F.date_add(start, 13)
        return self._sprint_ids.select(
            "sprint_id",
            _sprint_name(n, F.col("sprint_id") % 2).alias("sprint_name"),
            start.cast("string").alias("start_date"), end.cast("string").alias("end_date"),
            start.cast("timestamp_ntz").alias("created_at"),
            end.cast("timestamp_ntz").alias("updated_at"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.raw("labels").select(
            F.concat(F.lit("K-"), F.col("doc_id").cast("string")).alias("issue_key"),
            F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("complexity_reasoning"),
            (F.col("quality") * 0.5 + 0.25).cast("double").alias("clarity_score"),
            F.lit(None).cast("string").alias("clarity_notes"),
            F.lit(AS_OF).cast("timestamp_ntz").alias("analyzed_at"),
        )

    @cached_property
    def weekly(self) -> DataFrame:
        return maintenance.weekly_metrics(self.issues)

    @cached_property
    def bridge(self) -> DataFrame:
        return maintenance.sprint_issues(self.issues, self.changelog)

    @cached_property
    def sprint_totals(self) -> DataFrame:
        """Story points per sprint name from today's assignment."""
        return self.issues.filter(F.col("sprint_name").isNotNull()).groupBy("sprint_name").agg(
            F.sum("reported_sp").alias("total_sp"))

    @cached_property
    def future_sp(self) -> DataFrame:
        """Open work, as the one-row input of the sufficiency figures."""
        return self.issues.filter(F.col("status_category") == "To Do").agg(
            F.sum("reported_sp").alias("future_sp"))

    @cached_property
    def history(self) -> DataFrame:
        """A sufficiency history with one row per week of issue creation."""
        weekly = self.issues.groupBy(week_start(F.col("created")).alias("snapshot_date")).agg(
            F.sum(F.when(F.col("status_category") == "To Do", F.col("reported_sp")).otherwise(0.0))
            .alias("future_sp"),
            F.sum("reported_sp").alias("avg_velocity"))
        share = F.col("future_sp") / F.nullif(F.col("avg_velocity"), F.lit(0.0)) * 100
        return weekly.withColumn("sufficiency", F.coalesce(share, F.lit(0.0)))

    @cached_property
    def source_sprints(self) -> DataFrame:
        """What the tracker lists now: each state has moved one step on since the last sync."""
        return self.sprints.select(
            "sprint_id", "sprint_name",
            _lookup("state", {"future": "active", "active": "closed", "closed": "closed"}).alias("state"),
        )

    @cached_property
    def registry_now(self) -> DataFrame:
        """The registry as a new sync writes it: states moved on, no snapshot columns filled."""
        return self.sprints.withColumns({
            "state": _lookup("state", {"future": "active", "active": "closed", "closed": "closed"}),
            "planned_sp_snapshot": F.lit(None).cast("double"),
            "snapshot_created_at": F.lit(None).cast("timestamp_ntz"),
        })

    # ── raw documents ───────────────────────────────────────────────────────────────────────

    @cached_property
    def raw_text(self) -> DataFrame:
        """One landed JSON line per issue: nested document, a comment and a change of two fields.

        Nulls are left out of the JSON, so optional parts are really missing.
        """
        def stamp(name: str) -> Column:
            return F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0900"))

        def named(column: str, label: str = "name") -> Column:
            return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias(label)))

        comment = F.struct(
            F.concat(F.lit("c-"), F.col("key")).alias("id"),
            named("assignee", "displayName").alias("author"),
            rich_document(F.col("summary")).alias("body"),
            stamp("created").alias("created"))
        status_item = F.struct(
            F.lit("status").alias("field"), F.lit("To Do").alias("fromString"),
            F.col("status").alias("toString"))
        sprint_item = F.struct(
            F.lit("Sprint").alias("field"), F.lit(None).cast("string").alias("fromString"),
            F.col("sprint_name").alias("toString"))
        change = F.struct(
            F.lit("h1").alias("id"), named("assignee", "displayName").alias("author"),
            stamp("updated").alias("created"), F.array(status_item, sprint_item).alias("items"))
        fields = F.struct(
            "summary",
            named("assignee", "displayName").alias("assignee"),
            F.col("reported_sp").alias(schemas.STORY_POINTS_FIELD),
            F.struct(F.col("status").alias("name"),
                     F.struct(F.col("status_category").alias("name")).alias("statusCategory"))
            .alias("status"),
            named("priority").alias("priority"),
            named("issuetype").alias("issuetype"),
            named("resolution").alias("resolution"),
            F.when(F.col("flagged"), F.array(F.struct(F.lit("Impediment").alias("value"))))
            .alias("flagged"),
            stamp("created").alias("created"),
            stamp("updated").alias("updated"),
            F.when(F.col("description").isNotNull(), rich_document(F.col("description")))
            .alias("description"),
            F.struct(F.array(comment).alias("comments")).alias("comment"),
        )
        issue = F.struct("key", fields.alias("fields"),
                         F.struct(F.array(change).alias("histories")).alias("changelog"))
        line = F.struct("board_name", "sprint_id", "sprint_name", issue.alias("issue"))
        # The driver's table is one unsplittable file; spread it before the costly conversion.
        return self.described_issues.repartition("key").select(F.to_json(line).alias("value"))

    @cached_property
    def landed(self) -> str:
        """Folder of the lines as files, the way the tracker's documents arrive."""
        folder = shared_dir(self.spark, "landed")
        _land(self.raw_text, folder)
        return folder

    @cached_property
    def raw_issues(self) -> DataFrame:
        return read_raw_issues(self.spark, self.landed)

    @cached_property
    def damaged_issues(self) -> DataFrame:
        """The landed lines, every seventh cut off in the middle, every eleventh other one without
        its issue's key."""
        number = F.regexp_extract("value", '"key":"K-([0-9]+)"', 1).cast("long")
        half = F.substring(F.col("value"), F.lit(1), F.floor(F.length("value") / 2).cast("int"))
        line = F.when(number % 7 == 0, half).when(
            number % 11 == 0, F.regexp_replace("value", '"key":"K-[0-9]+",', "")).otherwise(F.col("value"))
        folder = shared_dir(self.spark, "damaged")
        _land(self.raw_text.select(line.alias("value")), folder)
        return read_raw_issues(self.spark, folder)

    @cached_property
    def raw_sprints(self) -> DataFrame:
        """Sprint pages: two sprints of one window per page, oldest first."""
        def entry(odd: int) -> Column:
            n = F.col("page")
            start = F.date_add(F.lit(EPOCH).cast("date"), n * 14)
            return F.struct(
                (n * 2 + odd).alias("id"),
                _sprint_name(n, F.lit(odd)).alias("name"),
                F.when(n >= 171, "future").when(n >= 169, "active").when(n >= 1, "closed").alias("state"),
                start.cast("string").alias("startDate"),
                F.date_add(start, 13).cast("string").alias("endDate"),
                F.when(n < 169, F.date_add(start, 13).cast("string")).alias("completeDate"))

        pages = self.raw("orders").select(_window(F.col("o_orderdate")).alias("page")).distinct()
        return pages.select(
            F.lit("Main Board").alias("board_name"), "page",
            F.array(entry(0), entry(1)).alias("values"))
