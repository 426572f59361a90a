"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import blocks_of, bounded_batches
from tidemark.llm.tokens import default_tokenizer, word_ids
from tidemark.session import materialize

# Items packed together: far above the items of a sequence, so that a block's last open bins weigh little.
BLOCK_ITEMS = 8_192
# Of short items a block takes more, up to MOST_ITEMS, until they fill so many sequences.
BLOCK_BINS, MOST_ITEMS = 256, 1 << 20
END_ID = 0


def token_pieces(
    docs: DataFrame,
    max_tokens: int = 2_048,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as token pieces: doc_id, piece, start, length, ids_crc32.

    The ids of a text and a closing id 0; only longer documents are cut, into pieces of
    ``max_tokens`` of which the last may be shorter. A null text counts as empty (one piece of one
    id). Repeated rows give repeated pieces; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )
    width = 4 * max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(demand: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin number of each item; ``demand`` holds shares of each capacity, 1 being all of it.

    Items come in falling order of their weighted share. Among the open bins that can take an item
    under every capacity, ``norm`` picks the one whose weighted residual is shortest afterwards and
    ``dot`` the one whose residual has the least weighted dot product with the item. Ties go to the
    older bin; an item that fits nowhere opens one.
    """
    n, kinds = demand.shape
    order = np.argsort(-(demand * weights).sum(axis=1), kind="stable")
    least = demand.min(axis=0) if n else np.zeros(kinds)
    bins = np.empty(n, np.int64)
    slack = 1e-9
    number = np.empty(n, np.int64)
    room = np.empty((kinds, n))
    opened = live = 0
    for i in order:
        d = demand[i]
        fits = np.ones(live, bool)
        for k in range(kinds):
            fits &= room[k, :live] >= d[k] - slack
        at = np.flatnonzero(fits)
        if len(at):
            left = room[:, at]
            if rule == "norm":
                score = (weights[:, None] * (left - d[:, None]) ** 2).sum(axis=0)
            else:
                score = ((weights * d)[:, None] * left).sum(axis=0)
            j = at[np.argmin(score)]
            room[:, j] -= d
        else:
            j = live
            room[:, j] = 1.0 - d
            number[j] = opened
            opened += 1
            live += 1
        bins[i] = number[j]
        if (room[:, j] < least - slack).any():  # no item left can enter: close it, keep the order of the rest
            room[:, j : live - 1] = room[:, j + 1 : live]
            number[j : live - 1] = number[j + 1 : live]
            live -= 1
    return bins


def pack(
    items: DataFrame,
    demands: Mapping[str, tuple[float, float]],
    rule: str = "norm",
    block_items: int = BLOCK_ITEMS,
    order_col: str = "length",
) -> DataFrame:
    """Items with ``sequence_id`` and ``offset``: vector best-fit in even blocks.

    ``demands`` maps a column to (capacity, weight); no item may exceed a capacity on its own. A block
    has ``block_items`` items, or more where those would fill few sequences. The
    items are written once and dealt over blocks by row position, so neither a common id nor repeated
    rows gather in one task. ``offset`` is the running sum of ``order_col`` within the sequence.
    """
    names = list(demands)
    caps = np.array([float(demands[k][0]) for k in names])
    weights = np.array([float(demands[k][1]) for k in names])
    if not names or (caps <= 0).any() or (weights < 0).any() or rule not in ("norm", "dot"):
        raise ValueError("packing needs positive capacities, weights from 0 up, and rule norm or dot")
    table = materialize(items)
    count, *filled = table.agg(F.count("*"), *(F.sum(F.col(k).cast("double")) for k in names)).first()
    need = max((v or 0.0) / c for v, c in zip(filled, caps, strict=True))
    blocks = max(1, -(-count // MOST_ITEMS), min(-(-count // block_items), int(need // BLOCK_BINS)))
    table = blocks_of(table, max(1, -(-count // blocks)))
    out = T.StructType(
        [f for f in table.schema.fields if f.name != "_block"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        demand = rows[names].to_numpy(float) / caps
        if (demand > 1 + 1e-9).any():
            raise ValueError("an item exceeds a capacity")
        bins = best_fit(demand, weights, rule)
        rows = rows.drop(columns="_block").assign(sequence_id=(int(key[0]) << 32) + bins)
        rows = rows.sort_values("sequence_id", kind="stable")
        size = rows[order_col]
        return rows.assign(offset=(size.groupby(rows["sequence_id"]).cumsum() - size).astype("int64"))

    return table.groupBy("_block").applyInPandas(fill, out)


def pack_documents(
    docs: DataFrame,
    max_tokens: int = 2_048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    tokenizer: str | None = None,
    rule: str = "norm",
) -> DataFrame:
    """Pieces of all documents with their place in sequences.

    Three capacities hold for a sequence: tokens, pieces and attention cost (the sum of squared
    piece lengths). By default the last two are as wide as the tokens allow.
    """
    pieces = token_pieces(docs, max_tokens, tokenizer)
    items = pieces.withColumn("_one", F.lit(1)).withColumn("_cost", F.col("length").cast("double") ** 2)
    packed = pack(
        items,
        {
            "length": (max_tokens, 1.0),
            "_one": (max_documents or max_tokens, 1e-4),
            "_cost": (max_attention or float(max_tokens) ** 2, 1e-4),
        },
        rule,
    )
    return packed.drop("_one", "_cost")
