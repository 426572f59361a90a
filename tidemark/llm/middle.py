"""Fill-in-the-middle texts, put together from pieces by a secondary sort.

No task ever holds a document's transformed text. Documents are cut into pieces of at most ``PIECE`` characters,
keyed by document and place in the output; ``repartitionAndSortWithinPartitions`` deals documents over
partitions and streams each one's pieces in order into a running digest. While it does so, the stream is parsed
for its markers again, and what it holds goes, keyed by document and place in the original, through a second
sort that restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

# Fixed marks of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Characters of a piece, and of a part of a text that is looked at at a time.
PIECE, PART = 65_536, 1 << 20
# Segment of a document's summary, after those of its text.
_END = 3
# Pieces are compressed with a dictionary of so many bytes, from the first characters of so many texts.
DICTIONARY, SAMPLE_TEXTS, SAMPLE_CHARS = 131_072, 2_000, 4_000


class Cut(NamedTuple):
    """How a text is transformed: its units, its form, and where prefix and middle end (in characters)."""

    n: int
    form: str
    first: int
    second: int


def _unit_starts(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of the text, its place and the characters in it that begin a unit."""
    inside = False
    for lo in range(0, len(text), PART):
        points = np.frombuffer(text[lo : lo + PART].encode("utf-32-le"), "<u4")
        lower = points | 32
        letter = (lower >= 97) & (lower <= 122) & (points < 128)
        before = np.concatenate(([inside], letter[:-1]))
        yield lo, np.flatnonzero(~(letter & before))
        inside = bool(letter[-1])


def cut_text(doc_id: int | None, text: str) -> Cut:
    """The cut of a text by the digest of its document's id (a null id counts as the word null)."""
    n = sum(len(at) for _, at in _unit_starts(text))
    name = "null" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 90:
        return Cut(n, "plain", 0, 0)
    wanted = sorted((h1 % (n + 1), h2 % (n + 1)))
    found = [len(text), len(text)]
    passed = 0
    for lo, at in _unit_starts(text):
        for i, unit in enumerate(wanted):
            if passed <= unit < passed + len(at):
                found[i] = lo + int(at[unit - passed])
        passed += len(at)
    return Cut(n, "spm" if h4 % 100 < 20 else "psm", *found)


def _pieces(text: str, cut: Cut) -> Iterator[str]:
    """The output in order: each segment with its mark, in pieces of at most ``PIECE`` characters beside the mark."""
    a, b = cut.first, cut.second
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, len(text))
    rows = {"plain": [("", 0, len(text))], "psm": [prefix, suffix, middle], "spm": [suffix, prefix, middle]}[cut.form]
    for mark, lo, hi in rows:
        yield mark + text[lo : min(hi, lo + PIECE)]
        for at in range(lo + PIECE, hi, PIECE):
            yield text[at : min(hi, at + PIECE)]


class Packer:
    """Compresses pieces with a dictionary trained on a sample of texts; pieces of short texts hold little to learn from."""

    def __init__(self, dictionary: bytes) -> None:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        lean = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self._pack = zstandard.ZstdCompressor(level=6, dict_data=known, **lean)
        self._unpack = zstandard.ZstdDecompressor(dict_data=known)

    def pack(self, piece: str) -> bytes:
        return self._pack.compress(piece.encode())

    def unpack(self, data: bytes) -> bytes:
        return self._unpack.decompressobj().decompress(data)


def sample_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """A compression dictionary from the beginnings of at most ``SAMPLE_TEXTS`` texts; it changes sizes, not results."""
    head = F.substring(F.col(text_col), 1, SAMPLE_CHARS)
    texts = docs.select(head.alias("head")).where("head <> ''").limit(SAMPLE_TEXTS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r["head"].encode() for r in texts]).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def output_pieces(docs: DataFrame, dictionary: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, place, doc_id, n, form, prefix_chars, middle_chars, piece: the output of each row in pieces.

    ``_row`` numbers the rows of ``docs`` (a table that reads the same again, such as files), so that repeated ids
    stay apart. The summary columns stand in the first piece alone; ``piece`` is UTF-8, compressed.
    """
    bounded_batches(docs.sparkSession)
    fields = [
        ("_row", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.binary()),
    ]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(dictionary)
        for batch in batches:
            rows, size = [], 0
            for row, key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = cell.as_py() or ""
                cut = cut_text(key, text)
                lengths = (None, None) if cut.form == "plain" else (cut.first, cut.second - cut.first)
                head = (key, cut.n, cut.form, *lengths)
                for place, piece in enumerate(_pieces(text, cut)):
                    data = packer.pack(piece)
                    rows.append((row, place, *(head if place == 0 else (None,) * 5), data))
                    size += len(data)
                    if size > 8 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            yield _batch(rows, schema)

    kinds = "_row long, place int, doc_id long, n long, form string, prefix_chars long, middle_chars long, piece binary"
    return docs.select(
        F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col)
    ).mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _sorted(pieces: RDD, partitions: int) -> RDD:
    """Keyed pieces dealt by document, in order of document and place."""
    return pieces.repartitionAndSortWithinPartitions(partitions, lambda key: key[0])


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(
        df.rdd.getNumPartitions(),
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def assembled(docs: DataFrame, dictionary: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> RDD:
    """The pieces of all outputs, keyed by (row, place) and sorted: each document's text in order.

    Values are compressed UTF-8; that of a first piece is (doc_id, n, form, prefix_chars, middle_chars, UTF-8).
    """
    pieces = output_pieces(docs, dictionary, id_col, text_col)
    keyed = pieces.rdd.map(lambda r: ((r[0], r[1]), tuple(r[2:8]) if r[1] == 0 else bytes(r[7])))
    return _sorted(keyed, _partitions(docs))


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, form, place, piece: the transformed texts in readable pieces.

    A row's pieces joined in order of ``place`` are its output; they stand together, in order.
    """
    dictionary = sample_dictionary(docs, text_col)

    def read(rows: Iterable[tuple]) -> Iterator[Row]:
        packer = Packer(dictionary)
        head: tuple = ()
        for (row, place), value in rows:
            if place == 0:
                head, value = value[:5], value[5]
            yield Row(row, head[0], head[2], place, packer.unpack(value).decode())

    spark = docs.sparkSession
    found = assembled(docs, dictionary, id_col, text_col).mapPartitions(read)
    return spark.createDataFrame(found, "_row long, doc_id long, form string, place int, piece string")


class Parser:
    """Reads an output piece by piece and says where in the original each part of it stands.

    ``feed`` yields (segment, text), segment 0 being the prefix (or a plain text), 1 the middle, 2 the suffix.
    A mark may be cut between two pieces: what could begin one is held back.
    """

    def __init__(self, form: str) -> None:
        segment = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
        marks = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}[form]
        self.form = form
        self.marks = [(m, segment[m]) for m in marks]
        self.segment = 0
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        piece = self.held + piece
        self.held = ""
        while self.marks:
            mark, segment = self.marks[0]
            at = piece.find(mark)
            if at < 0:
                keep = next((k for k in range(len(mark) - 1, 0, -1) if piece.endswith(mark[:k])), 0)
                self.held = piece[len(piece) - keep :]
                piece = piece[: len(piece) - keep]
                break
            if at:
                yield self.segment, piece[:at]
            piece = piece[at + len(mark) :]
            self.segment = segment
            self.marks.pop(0)
        if piece:
            yield self.segment, piece

    def close(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield self.segment, self.held
            self.held = ""


def _restoring(rows: Iterable[tuple], dictionary: bytes = b"") -> Iterator[tuple]:
    """Digest each output and key its parts by document and place in the original; its summary follows at ``_END``.

    A plain output is its original as it stands: only its digest goes on.
    """
    packer = Packer(dictionary)
    row, head, digest, parser, place = None, (), None, None, 0

    def keyed(parts: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        nonlocal place
        for segment, text in parts:
            if parser.form != "plain":
                yield (row, segment, place), packer.pack(text)
                place += 1

    def done() -> Iterator[tuple]:
        if row is not None:
            yield from keyed(parser.close())
            yield (row, _END, 0), (*head, digest.digest())

    for (next_row, at), value in rows:
        if at == 0:
            yield from done()
            row, head, digest, parser, place = next_row, value[:5], hashlib.sha256(), Parser(value[2]), 0
            value = value[5]
        data = packer.unpack(value)
        digest.update(data)
        yield from keyed(parser.feed(data.decode()))
    yield from done()


def restored(docs: DataFrame, dictionary: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> RDD:
    """The originals, rebuilt from the outputs: keyed by (row, segment, place) and sorted, a summary after each."""
    out = assembled(docs, dictionary, id_col, text_col)
    return _sorted(out.mapPartitions(lambda rows: _restoring(rows, dictionary)), out.getNumPartitions())


def _digests(rows: Iterable[tuple], dictionary: bytes = b"") -> Iterator[tuple]:
    packer = Packer(dictionary)
    digest = hashlib.sha256()
    for (_, segment, _), value in rows:
        if segment == _END:
            output = value[5].hex()
            yield (*value[:5], output, output if value[2] == "plain" else digest.hexdigest())
            digest = hashlib.sha256()
        else:
            digest.update(packer.unpack(value))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: one row per row of ``docs``.

    A text is cut into units (a run of ASCII letters, or any other character) and into prefix, middle and suffix at
    two unit borders drawn from the digest of its id; ``outputs`` gives the transformed texts themselves. A null or
    empty text, one that holds a mark, and a tenth of the others stay plain. Rows that repeat an id have a row each; a
    null id is drawn as the word null; an empty table gives no row. Columns beside id and text are not looked at.

    Documents are dealt by row, so neither a repeated id nor a common text gathers in a task. A document of any
    length streams through one task piece by piece; sorts spill, and lost tasks are made again from the files.
    """
    spark = docs.sparkSession
    dictionary = sample_dictionary(docs, text_col)
    found = restored(docs, dictionary, id_col, text_col).mapPartitions(lambda rows: _digests(rows, dictionary))
    kinds = (
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
        "restored_sha256 string"
    )
    return spark.createDataFrame(found, kinds)
