"""Rich-text documents to plain text: the one per-row Python step of the ingest job.

The tree has no depth limit, so a column expression cannot walk it. Batches arrive through
Arrow; the walk keeps its own stack and so is not bound by Python's recursion limit.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: node types whose children are put on lines of their own.
BLOCK_TYPES = frozenset({
    "doc", "paragraph", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock",
    "heading", "table", "tableRow", "tableCell",
})


def _open(node: object) -> tuple[str, list] | str:
    """A leaf's text, or (separator, children) for a node that has to be walked."""
    if node is None:
        return ""
    if isinstance(node, list):
        return "\n", node
    if isinstance(node, dict):
        if node.get("type") == "text":
            return str(node.get("text", ""))
        return ("\n" if node.get("type") in BLOCK_TYPES else ""), node.get("content") or []
    return node if isinstance(node, str) else str(node)


def plain_text(document: object) -> str:
    """Text of a parsed document tree."""
    root = _open(document)
    if isinstance(root, str):
        return root
    # One frame per open node: separator, children still to visit, texts collected so far.
    frames: list[tuple[str, object, list[str]]] = [(root[0], iter(root[1]), [])]
    while True:
        separator, children, texts = frames[-1]
        for child in children:
            opened = _open(child)
            if isinstance(opened, str):
                texts.append(opened)
            else:
                frames.append((opened[0], iter(opened[1]), []))
                break
        else:
            frames.pop()
            if not frames:
                return separator.join(texts)
            frames[-1][2].append(separator.join(texts))


def _from_json(text: object) -> str | None:
    """Text of a JSON value. What is not JSON, or is nested deeper than the parser goes, stays as it is."""
    if not isinstance(text, str):
        return None
    if text[:1] not in ("{", "[", '"'):
        return "" if text == "null" else text
    try:
        return plain_text(json.loads(text))
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def _rich_text(documents: pd.Series) -> pd.Series:
    return documents.map(_from_json)


def rich_text(document: Column) -> Column:
    """Plain text of a variant: a tree's text, a string as it is, nothing for a missing one. Strings do not
    go through Python, and only they and missing ones come back from there as null."""
    # The schema tells a string for less than its JSON text does, which is made once, for all others.
    tree = _rich_text(F.when(F.schema_of_variant(document) != "STRING", F.to_json(document)))
    return F.coalesce(tree, F.try_variant_get(document, "$", "string"), F.lit(""))


def rich_text_to_plain(df: DataFrame, column: str) -> DataFrame:
    """The column's JSON texts as plain text. Texts that are not JSON stay as they are."""
    return df.withColumn(column, F.coalesce(_rich_text(F.col(column)), F.lit("")))
