"""Token counts by source, language and tokenizer version, maintained from signed changes.

A batch of changes holds inserts, deletes and revised counts. It is reduced to what it adds to the totals and
committed under its own name. Totals are the sum over all committed batches, so the order of commits
does not matter, and committing a batch again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sprintloom.llm.bpe import Encoder
from sprintloom.llm.common import word_lists

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "change string, source string, lang string, tokenizer string, tokens long, old_tokens long"
BPE, WORDS = "byte_bpe_50k/1", "words/1"


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id",
                 source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, source, lang, bpe_tokens, words`` of each row's whole text. A null text has no tokens. Other columns
    are not read, repeated rows are counted each, and null keys stay null."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array([len(encoder.encode(t)) // 4 for t in texts], pa.int64()),
                                   pa.array([sum(map(len, word_lists(t))) for t in texts], pa.int64())],
                                  names=["doc_id", "source", "lang", "bpe_tokens", "words"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, bpe_tokens long, words long")


def delta(changes: DataFrame) -> DataFrame:
    """What a batch adds to the totals: ``source, lang, tokenizer, documents, tokens``.

    ``insert`` adds a document and its tokens, ``delete`` takes them away, and ``revise`` replaces ``old_tokens`` by
    ``tokens``. Null counts are zero and null keys are keys. Any other change is an error. Sums are
    combined before they are shuffled, so a source with most of the rows is a few rows per task.
    """
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("change")
    known = F.when(kind.isin("insert", "delete", "revise"), True).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(kind, F.lit("null")))))
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    added = F.when(kind == "revise", tokens - old).otherwise(sign * tokens)
    return changes.filter(known).groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("documents"), F.sum(added).cast("long").alias("tokens"))


class Rollup:
    """Totals below ``root``, a folder that all executors share.

    A batch's delta is written to a folder of its own. It counts once a file named after the batch exists, which names that
    folder: the file is written under another name and then renamed, without replacing one that is there, so
    whoever comes second finds it whole. A writer that is lost before that step leaves files that nothing refers
    to. A file of that name without content, as a store without such a step may leave, counts as none and is replaced.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.root}/{name}")
        self._fs = self._path("commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch once. False, and nothing changes, if a batch of that name was committed before."""
        name = "".join(c if c.isalnum() or c in "-_" else f"%{ord(c):x}" for c in batch)
        marker = self._fs.makeQualified(self._path(f"commits/{name}"))
        if self._content(marker):
            return False
        folder = f"deltas/{name}-{uuid.uuid4().hex}"
        delta(changes).write.parquet(f"{self.root}/{folder}")
        return self._name(marker, folder)

    def _content(self, path) -> str:
        if not self._fs.exists(path):
            return ""
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _name(self, marker, folder: str) -> bool:
        """Make the marker that names a folder, in one step; False if another one was there first."""
        draft = self._path(f"commits/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(folder.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if self._fs.exists(marker) and not self._content(marker) else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(marker.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(marker), how)
        except Exception:
            self._fs.delete(draft, False)
            if self._content(marker):
                return False
            raise
        return True

    def _committed(self) -> list[str]:
        paths = [s.getPath() for s in self._fs.listStatus(self._path("commits"))]
        names = [self._content(p) for p in paths if not p.getName().startswith(("_", "."))]
        return [n for n in sorted(names) if n]

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches; keys at zero are left out."""
        folders = [f"{self.root}/{n}" for n in self._committed()]
        kind = "source string, lang string, tokenizer string, documents long, tokens long"
        if not folders:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*folders)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter(
            "documents <> 0 or tokens <> 0")
