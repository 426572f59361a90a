"""Token ids in Re-Pair compressed shards, with random access by expansion lengths.

Shard format, all numbers little-endian:

    magic            8 bytes  b"TMREPAIR"
    version, end id  2 x uint32
    ids, documents, terminals, rules, symbols   5 x uint64
    rule widths      1 byte each part: bytes per symbol (2 or 4)
    documents        ids per document, uint32 (the document ids are a column beside the shard)
    rules            left and right symbol per rule, uint32 pairs; rule k is symbol terminals + k
    expansions       expanded length of each rule, uint32
    sequence         the remaining symbols

A symbol below ``terminals`` is an id. ``decode_range`` expands only the symbols that overlap a range
of ids: running sums of the expansion lengths find them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.tokens import default_tokenizer, word_ids

MAGIC, VERSION = b"TMREPAIR", 1
_HEAD = struct.Struct("<8sIIQQQQQB")
END_ID = 2
SHARD_IDS = 1 << 19
MIN_COUNT = 8
RULES_A_ROUND = 4_096
LEAST_GAIN = 0.01
_SPREAD = 256
_SLOT_BITS = 17


def _pairs(seq: np.ndarray) -> np.ndarray:
    out = np.empty((len(seq) - 1, 2), "<u4")  # the right symbol is the low half
    out[:, 0] = seq[1:]
    out[:, 1] = seq[:-1]
    return out.view("<u8").ravel()


def _starts(marked: np.ndarray) -> np.ndarray:
    """Positions to replace: of each run of marked positions every second one, from its first."""
    place = np.arange(1, len(marked) + 1, dtype=np.int32)
    # How far behind the last position without a mark: an odd number of steps in every second place.
    gap = np.maximum.accumulate(np.where(marked, np.int32(0), place))
    np.subtract(place, gap, out=gap)
    gap &= 1
    return np.flatnonzero(gap)


def compress(ids: np.ndarray, terminals: int, min_count: int = MIN_COUNT, rules_a_round: int = RULES_A_ROUND):
    """Sequence, rules (left, right) and expansion lengths of a Re-Pair grammar.

    Each round counts all adjacent pairs and replaces the most frequent ones, up to ``rules_a_round``,
    by new nonterminals: a pair much rarer than the most frequent one waits for the counts of the next
    round, until a round shortens the sequence by less than ``LEAST_GAIN``; from then on none waits.
    Overlaps go to the left; a pair left without two uses gets no rule. It ends when no pair occurs
    ``min_count`` times.
    """
    seq = np.array(ids, np.uint32)
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    next_symbol = terminals
    spread, most = _SPREAD, rules_a_round
    slots = np.empty(1 << _SLOT_BITS, np.int32)
    while len(seq) > 1:
        pairs = _pairs(seq)
        order = np.sort(pairs)
        edge = np.flatnonzero(order[1:] != order[:-1]) + 1
        edge = np.concatenate(([0], edge, [len(order)]))
        count = np.diff(edge)
        top = int(count.max())
        if top < min_count:
            break
        good = np.flatnonzero(count >= (max(min_count, top // spread) if spread else min_count))
        if len(good) > most:
            good = good[np.argsort(-count[good], kind="stable")[:most]]
        else:
            good = good[np.argsort(-count[good], kind="stable")]
        chosen = order[edge[good]]
        # Pairs are found again through a table of hashed slots; of two in a slot the more frequent stays.
        slot = _slot(chosen)
        slots.fill(0)
        slots[slot[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
        place = slots[_slot(pairs)]
        at = _starts(chosen[place] == pairs)
        which = place[at]
        used = np.bincount(which, minlength=len(chosen)) >= 2
        keep = used[which]
        at, which = at[keep], which[keep]
        if not len(at):  # each took the others' places: the most frequent one alone has two uses
            if most == 1:
                break
            most = 1
            continue
        most = rules_a_round
        name = np.cumsum(used) - 1
        lefts.append((chosen[used] >> np.uint64(32)).astype(np.uint32))
        rights.append((chosen[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        before = len(seq)
        seq[at] = (next_symbol + name[which]).astype(np.uint32)
        drop = np.ones(before, bool)
        drop[at + 1] = False
        seq = seq[drop]
        next_symbol += int(used.sum())
        if before - len(seq) < LEAST_GAIN * before:
            spread = 0
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.uint32)
    right = np.concatenate(rights) if rights else np.zeros(0, np.uint32)
    return seq, left, right, expansions(left, right, terminals)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def expansions(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """Expanded length of each rule; a rule only names terminals and earlier rules."""
    out = np.zeros(len(left), np.uint32)
    todo = np.arange(len(left))
    while len(todo):
        l, r = left[todo].astype(np.int64) - terminals, right[todo].astype(np.int64) - terminals
        a = np.where(l < 0, 1, out[np.maximum(l, 0)])
        b = np.where(r < 0, 1, out[np.maximum(r, 0)])
        known = (a > 0) & (b > 0)
        out[todo[known]] = (a + b)[known]
        todo = todo[~known]
    return out


def rule_pool(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' ids one after another, and where each rule's begin."""
    lengths = np.asarray(lengths, np.int64)
    begin = np.cumsum(lengths) - lengths
    pool = np.empty(int(lengths.sum()), np.uint32)
    sides = np.stack([left, right], axis=1).astype(np.int64) if len(left) else np.zeros((0, 2), np.int64)
    size = np.where(sides < terminals, 1, lengths[np.maximum(sides - terminals, 0)]) if len(left) else sides
    level = np.zeros(len(left), np.int64)
    deeper = True
    while deeper:  # a rule lies one level above its parts
        inner = np.where(sides < terminals, -1, level[np.maximum(sides - terminals, 0)]).max(axis=1, initial=-1) + 1
        deeper = bool((inner != level).any())
        level = inner
    for depth in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == depth)
        for side, to in ((0, begin[at]), (1, begin[at] + size[at, 0])):
            part, n = sides[at, side], size[at, side]
            plain = part < terminals
            pool[to[plain]] = part[plain]
            source = begin[part[~plain] - terminals]
            pool[_ranges(to[~plain], n[~plain])] = pool[_ranges(source, n[~plain])]
    return pool, begin


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    end = np.cumsum(size, dtype=begin.dtype)
    total = int(end[-1]) if len(end) else 0
    out = np.repeat(begin - (end - size), size)
    out += np.arange(total, dtype=begin.dtype)
    return out


def expand(seq: np.ndarray, size: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """All ids of a run of symbols; ``size`` and ``begin`` place each symbol's ids in the pool."""
    return pool[_ranges(begin[seq], size[seq])]


def write_shard(ids: np.ndarray, doc_lengths: np.ndarray, terminals: int, end_id: int = END_ID) -> bytes:
    seq, left, right, lengths = compress(ids, terminals)
    wide = terminals + len(left) > 0xFFFF
    head = _HEAD.pack(
        MAGIC, VERSION, end_id, len(ids), len(doc_lengths), terminals, len(left), len(seq), 4 if wide else 2
    )
    rules = np.stack([left, right], axis=1) if len(left) else np.zeros((0, 2), np.uint32)
    return b"".join(
        [
            head,
            np.asarray(doc_lengths, "<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            seq.astype("<u4" if wide else "<u2").tobytes(),
        ]
    )


class Shard:
    """A shard read back; documents and ranges of ids can be decoded on their own."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.end_id, self.n_ids, docs, self.terminals, rules, symbols, width = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        at = _HEAD.size
        self.doc_lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        pairs = np.frombuffer(data, "<u4", 2 * rules, at).reshape(rules, 2)
        self.left, self.right = pairs[:, 0], pairs[:, 1]
        at += 8 * rules
        lengths = np.frombuffer(data, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.seq = np.frombuffer(data, "<u4" if width == 4 else "<u2", symbols, at).astype(np.uint32)
        pool, begin = rule_pool(self.left, self.right, lengths, self.terminals)
        # A terminal stands for itself: the pool opens with all of them.
        self.pool = np.concatenate((np.arange(self.terminals, dtype=np.uint32), pool))
        kind = np.int32 if len(self.pool) + self.n_ids < 2**31 else np.int64
        self.size = np.concatenate((np.ones(self.terminals, kind), lengths.astype(kind)))
        self.begin = np.concatenate((np.arange(self.terminals, dtype=kind), self.terminals + begin.astype(kind)))
        self.ends = np.cumsum(self.size[self.seq], dtype=np.int64)
        self.doc_ends = np.cumsum(self.doc_lengths)

    def decode(self) -> np.ndarray:
        return expand(self.seq, self.size, self.begin, self.pool)

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``: only the symbols over that range are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, stop, "left"))
        before = int(self.ends[first - 1]) if first else 0
        ids = expand(self.seq[first : last + 1], self.size, self.begin, self.pool)
        return ids[start - before : stop - before]

    def document(self, n: int) -> np.ndarray:
        stop = int(self.doc_ends[n])
        return self.decode_range(stop - int(self.doc_lengths[n]), stop)


def encode_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    terminals: int = 49_408,
    shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of every whole text, each closed by the end id, as shards under ``path``.

    Documents are ranged and sorted by id (ties by text, nulls first), so shards follow each other in
    ascending order: ``part``, ``shard`` and ``part_start`` (ids before it in its part) place them. A
    shard closes at the document that fills it; one document is never split. Spark's own writer
    commits the rows, so a lost executor leaves no half-written shard.
    """
    bounded_batches(docs.sparkSession)
    file = tokenizer or default_tokenizer()
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("shard", pa.int32()),
            ("part_start", pa.int64()),
            ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("data", pa.binary()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = word_ids(file)
        end = np.array([END_ID], "<u4").tobytes()
        keys: list = []
        texts: list[bytes] = []
        held = start = shard = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            data = write_shard(ids, np.array([len(x) // 4 for x in texts]), terminals)
            row = [[part], [shard], [start], [len(ids)], [keys], [data]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py() or "") + end
                keys.append(key)
                texts.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield close()
                    start, shard, held = start + held, shard + 1, 0
                    keys, texts = [], []
        if keys:
            yield close()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(
        encode, "part int, shard int, part_start long, n_ids long, doc_ids array<long>, data binary"
    )
    shards.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards under ``path``."""
    shards = spark.read.parquet(path)
    run = Window.orderBy("part")  # one row per part of the range partitioning
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(run) - F.col("ids")).alias("before"))
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("doc_id", pa.int64()),
            ("in_part", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                keys = batch.column(2)[i].as_py()
                shard = Shard(batch.column(3)[i].as_py())
                ids = shard.decode().astype("<u4")
                ends = shard.doc_ends
                begins = ends - shard.doc_lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                cols = [[part] * len(keys), keys, start + begins, shard.doc_lengths, crc]
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema
                )

    # Few shards a batch: each is a few megabytes before and after decoding.
    rows = shards.select("part", "part_start", "doc_ids", "data").mapInArrow(
        decode, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
