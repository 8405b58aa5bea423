"""Incremental load of newly landed raw issue files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.sync import store_documents
from ..schemas import CORRUPT, STORY_POINTS_FIELD, raw_issue_schema
from ..sources.raw import readable
from ..sources.tables import TableStore
from ..vocab import DEFAULT, Vocabulary


def incremental_ingest(store: TableStore, source_dir: str, checkpoint: str,
                       vocab: Vocabulary = DEFAULT,
                       story_points_field: str = STORY_POINTS_FIELD) -> None:
    """Merge the files that arrived since the last call, then return.

    The stream's checkpoint remembers which files are done. All waiting files form one batch, so
    each part it concerns is rewritten once per call however many files there are. The parsed batch is
    written first, so the tables share one pass over the JSON. The batch's tables are staged below its number
    and replaced together; a batch that is sent again, after whatever end of the writer, changes nothing more.
    Lines that cannot be read, and documents without a key, are never stored, and a stored state
    that is newer than a late file's stays.
    """
    store.recover()
    files = store.spark.readStream.schema(raw_issue_schema(story_points_field)).option(
        "columnNameOfCorruptRecord", CORRUPT).json(source_dir)

    def merge(batch: DataFrame, number: int) -> None:
        documents = store.written(readable(batch).drop(CORRUPT), "documents")
        store_documents(store, documents, vocab, str(number))

    query = (
        files.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
