"""Token counts from distinct pre-tokens.

Each block of documents is cut into pre-tokens, each distinct pre-token is given to the
tokenizer once, and its number of pieces is joined to the documents' pre-token
frequencies and summed; the ids of a document are never put together. No shuffle is
needed, so a hot source or a very long text costs its own bytes only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import blocks, ship, text_or_empty

#: Distinct pre-tokens that a worker remembers between blocks; memory only, results are the same.
REMEMBERED = 600_000

_counters: dict[str, object] = {}


class PieceCounter:
    """Counts the pieces of a sentencepiece model.

    A piece never holds the space mark after another character, so merges never cross
    the start of a run of spaces, and a text can be cut there. Models where that isn't
    so, and texts that hold the mark itself, are encoded whole.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        n = proto.normalizer_spec
        crossing = any(re.search(f"[^{self.MARK}]{self.MARK}", p.piece) or p.type == 4 for p in proto.pieces)
        self.splits = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and proto.trainer_spec.model_type == 2 and not crossing
        self.known: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._lengths(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut: list[list[str] | None] = []
        for x in texts:
            if not x or self.MARK in x:
                cut.append(None)
            elif "  " in x or x[0] == " " or x[-1] == " ":
                cut.append([p[1:] for p in re.findall(" +[^ ]*", " " + x)])
            else:
                cut.append(x.split(" "))
        new: set[str] = set()
        for parts in cut:
            if parts:
                new.update(parts)
        new.difference_update(self.known)
        if "" in new:  # a lone space mark, which the library can't be given alone
            new.discard("")
            self.known[""] = self._lengths(["a "])[0] - self._lengths(["a"])[0]
        fresh = list(new)
        self.known.update(zip(fresh, self._lengths(fresh), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, parts)) if parts else (self._lengths([x])[0] if x else 0) for parts, x in zip(cut, texts, strict=True)]


class VocabularyCounter:
    """Counts the tokens of a ``tokenizers`` file by its own normalizer and pre-tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pre, norm, out = self.model.pre_tokenizer, self.model.normalizer, []
        for x in texts:
            whole = pre is None or any(a in x or (norm and a in norm.normalize_str(x)) for a in self.added)
            if whole:
                out.append(len(self.model.encode(x, add_special_tokens=False).ids))
                continue
            total = 0
            for part, _ in pre.pre_tokenize_str(norm.normalize_str(x) if norm else x):
                if part not in self.known:
                    self.known[part] = len(self.model.model.tokenize(part))
                total += self.known[part]
            out.append(total)
        return out


def counter(path: str) -> PieceCounter | VocabularyCounter:
    if path not in _counters:
        _counters[path] = (PieceCounter if path.endswith(".model") else VocabularyCounter)(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty (0 tokens), whole texts are counted, however long, repeated rows and
    rows without an id are counted like all others, an empty table gives no rows, other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in blocks(batches, "_text"):
            n = count(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
