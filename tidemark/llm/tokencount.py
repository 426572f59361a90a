"""Token counts of whole texts by compiled transducers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.tokens import default_tokenizer
from tidemark.llm.transducer import token_counter


def count_tokens(
    docs: DataFrame,
    limit: int = 2_048,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``.

    ``n_tokens`` is what the tokenizer gives without added begin or end tokens; special strings inside a text
    count as the one token they are. ``over_limit`` says whether there are more than ``limit``. A null text
    counts as empty; rows that repeat an id, or whose id is null, each have a row; an empty table gives none.
    A text of any length is read in blocks within its task: nothing is shuffled, and a lost task is read again.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            total = counter.counts([t or "" for t in batch.column(2).to_pylist()])
            cols = [
                batch.column(0),
                batch.column(1),
                pa.array(total, pa.int64()),
                pa.array([n > limit for n in total], pa.bool_()),
            ]
            yield pa.record_batch(cols, schema=schema)

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long"), size, F.col(text_col)).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
