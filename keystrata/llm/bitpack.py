"""Token ids in bit-packed files.

Format: a Parquet data set whose rows are blocks of whole documents in ascending
``doc_id`` order. ``part`` numbers the files, ``block`` the blocks in a file,
``first_token`` is the block's offset in its file, ``doc_ids`` (int64) and ``ends``
(int64, token offsets in the block) describe its documents, the last ``n_nameless`` of
which have no id, and ``payload`` holds the ids, ``width`` bits each, least significant bit first. ``width`` is the smallest number
of bits that the vocabulary needs. Block offsets make any span of tokens readable
without the blocks before it, and the Parquet statistics skip the other blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import blocks, new_path, ship, text_or_empty

#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 18
#: Distinct chunks that a worker remembers; memory only, results are the same.
REMEMBERED = 1_100_000

FILE_SCHEMA = "part int, block int, first_token long, n_docs int, n_nameless int, n_tokens long, width int, doc_ids binary, ends binary, payload binary"

_encoders: dict[str, Encoder] = {}


def width_of(vocabulary: int) -> int:
    """Bits for ids 0 to ``vocabulary - 1``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each; raises if an id needs more."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id needs more bits than the width")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ((ids[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start``, as uint32; reads their bytes only."""
    if count <= 0:
        return np.empty(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first, last = start * width // 8, -(-(start + count) * width // 8)
    raw = np.concatenate([np.frombuffer(payload, np.uint8, last - first, first), np.zeros(8, np.uint8)])
    bit = (np.arange(count, dtype=np.int64) + start) * width - first * 8
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)[bit >> 3].copy().view("<u8").ravel()
    return ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class _Numbers(dict):
    """Numbers of chunks, from 0; looking one up numbers it, and ``new`` lists those numbered last."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a byte-level BPE file of the ``tokenizers`` library.

    Such a file's pre-tokenizer starts a pre-token at each space that a non-space
    follows, so a text without other white space beside spaces can be cut there; each
    distinct chunk is encoded once. All other texts are encoded whole.
    """

    #: Rarer white space, by any engine's view.
    RARE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    #: Spaces next to other white space.
    ADJACENT = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")

    def cuttable(self, text: str) -> bool:
        """Whether each space of ``text`` starts a pre-token."""
        return bool(self.splits and text) and text[0] != " " and text[-1] != " " and not any(a in text for a in self.ADJACENT) and not self.RARE.search(text) and not any(a in text for a in self.added)

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word)  # a byte is a character in this alphabet
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        #: The ids of all known chunks by number, and where each one's end; the first entry is 0.
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the chunks that are new, each after a space, as a few long texts, and cut the ids by their bytes."""
        new, self.known.new = self.known.new, []
        flat, sizes = [self.flat], []
        for at in range(0, len(new), 2000):
            text = " " + " ".join(new[at : at + 2000])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))  # chunks hold no space
            flat.append(ids)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1, prepend=0))
        if new:
            self.flat = np.concatenate(flat)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self._forget()
        number, heads, cut = self.known.__getitem__, [], []
        for x in texts:
            head, *parts = x.split(" ") if self.cuttable(x) else [x]
            heads.append(head)
            cut.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        out = []
        for head, at in zip(self.whole(heads), cut, strict=True):
            size = self.ends[at + 1] - self.ends[at]
            past = np.cumsum(size)
            # The place of each id: its chunk's first, and how far it is into the chunk.
            place = np.arange(past[-1] if len(at) else 0) + np.repeat(self.ends[at] - past + size, size)
            out.append(head + self.flat[place].tobytes())
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, add ``end_id`` and write the packed files to ``path``.

    Null texts count as empty; texts are encoded whole, however long; rows that repeat a ``doc_id`` stay, next to
    each other and by a hash of their texts; rows without an id come last, by that hash; an empty table writes an
    empty data set; other columns are ignored. Ranges are cut by a row's number too, so that no id fills one.
    """
    ship(docs.sparkSession)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part, block, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        width = width_of(max(e.vocabulary, (end_id or 0) + 1))
        ids: list[bytes] = []
        docs_in: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids], dtype="<i8")
            nameless = docs_in.count(None)
            named = np.array([0 if d is None else d for d in docs_in], "<i8").tobytes()
            row = {"part": part, "block": block, "first_token": first, "n_docs": len(ids), "n_nameless": nameless, "n_tokens": int(ends[-1])}
            row |= {"width": width, "doc_ids": named, "ends": ends.tobytes(), "payload": pack(np.frombuffer(b"".join(ids), "<u4"), width)}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for b in blocks(batches, "_text", 4 << 20):
            for doc, x in zip(b.column(0).to_pylist(), e.encode(b.column(1).to_pylist()), strict=True):
                ids.append(x + tail)
                docs_in.append(doc)
                held += len(ids[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield close()
                    block, first, held = block + 1, first + held, 0
                    ids.clear()
                    docs_in.clear()
        if ids:
            yield close()

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    keyed = narrow.withColumns({"_h": F.xxhash64("_text"), "_no": F.monotonically_increasing_id()})
    order = [F.col("_id").asc_nulls_last(), F.col("_h"), F.col("_no")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return path


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files, with ``start``: the ids of all files and blocks before."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("first_token")).drop("base")  # one row a file


def packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files' ids."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["width"], 0, r["n_tokens"]).astype("<u4")
                ends = np.frombuffer(r["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                named = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.arange(len(ends)) >= len(ends) - r["n_nameless"])
                columns = [named, pa.array(starts + r["start"]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks_ = read_packed(spark, path).select("start", "n_tokens", "n_nameless", "width", "doc_ids", "ends", "payload")
    return blocks_.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_span(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from the global position ``start``: random access through block offsets."""
    inside = read_packed(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_tokens") > start))
    out = []
    for r in inside.orderBy("start").toLocalIterator():
        at = max(0, start - r["start"])
        out.append(unpack(r["payload"], r["width"], at, min(r["n_tokens"], start + count - r["start"]) - at))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and describe what they hold."""
    spark = docs.sparkSession
    return packed_documents(spark, write_packed(docs, new_path(spark, "packed"), tokenizer, end_id))
