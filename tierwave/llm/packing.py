"""Packing: concatenate and cut.

Documents are tokenized once, each with an end id, and the ids are written with the running offset inside their
partition. A table of one total per partition gives each partition's global offset (the second prefix sum, as long as
there are partitions), and every document is then cut at the multiples of the sequence length. Only the last sequence
of the whole corpus can be short. A document that crosses a boundary gives a piece on each side of it.

Cases: null and empty texts are the end id alone; documents of any length are cut into as many pieces as needed;
repeated rows (and null doc_ids) are packed as often as they occur; an empty table gives no pieces; other columns are
ignored. A string of an added token in a text becomes that token, as the tokenizer has it.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Fixed value: where byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that the quick encoder's splitter has no stack for (it fails at a million, not at 100,000).
LONG, _RUN = 10_000, re.compile(r"\s{10000}")
_encoders: dict = {}


def _byte_names() -> dict[str, int]:
    """Byte-level BPE's names of bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _reached(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether the merges make each token out of its own bytes: the quick encoder takes it for granted."""
    order = {pair: k for k, pair in enumerate(merges)}
    for token in ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            k, i = min((order.get((parts[i], parts[i + 1]), len(order)), i) for i in range(len(parts) - 1))
            if k == len(order):
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


def quick_encoder(spec: dict):
    """The same vocabulary as merge ranks, or None where the two may not give the same ids.

    Ids that ascend with the merges are ranks, and what two tokens join to is then always joined by its own merge, as the
    bytes between two cuts are merged alike whatever stands around them. What is a token as a whole is never merged by the
    quick encoder, so the merges must lead to each token; that is tried for all of them.
    """
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    whole = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not (whole and cuts) or any(spec.get(x) for x in ("normalizer", "truncation", "padding")):
        return None
    names, vocab = _byte_names(), {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in spec["added_tokens"]}}
    merged = [vocab.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(vocab) != 256 + len(merged) or not names.keys() <= vocab.keys() or max(map(vocab.get, names)) > min(merged):
        return None
    ranks = {bytes(map(names.get, k)): v for k, v in vocab.items()}
    halves = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if not _reached(ranks, [tuple(bytes(map(names.get, x)) for x in m) for m in halves]):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    return tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian bytes, as the tokenizer gives them.

    Most texts go through quick_encoder(); texts with an added token or a very long run of white space, and all texts
    where the vocabulary has no quick encoder, through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.quick = quick_encoder(json.loads(self.tokenizer.to_str()))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.ids(t), self.kind).tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        if self.quick is None or any(s in text for s in self.special) or (len(text) >= LONG and _RUN.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, part (partition), start (offset in it), n_tokens, ids (little-endian, 2 or 4 bytes each)."""
    bound_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(enc.width, "little")
        for batch in batches:
            ids = [x + end for x in enc.encode([t or "" for t in batch.column(1).to_pylist()])]
            n = [len(x) // enc.width for x in ids]
            starts = [start]
            for x in n:
                starts.append(starts[-1] + x)
            start = starts.pop()
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * k, pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([enc.width] * k, pa.int32()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "start", "n_tokens", "width", "ids"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, start long, n_tokens long, width int, ids binary")


def pack(documents: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start (the document's ids before it), length, ids (array), doc_tokens, sequence_id, offset."""
    return _cut(documents, tokenizer, length, end_id, digest=False)


def pack_digest(documents: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """As pack(), with ids_crc32 (of little-endian unsigned 32-bit ids) in place of the ids."""
    return _cut(documents, tokenizer, length, end_id, digest=True)


def _cut(documents: DataFrame, tokenizer: str, length: int, end_id: int, digest: bool) -> DataFrame:
    from pyspark.sql import Window

    tokens = materialize(tokenize(documents, tokenizer, end_id), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each partition, so the window over them all and the broadcast are bounded by the partition count.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.coalesce("before", F.lit(0))).alias("at"), "width", "ids")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, at, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = wide[start : start + size]
                    for col, x in zip(out, (doc, start, size, zlib.crc32(piece.tobytes()) if digest else piece.astype("<i4"), n, sequence, offset), strict=True):
                        col.append(x)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64() if digest else pa.list_(pa.int32())), *(pa.array(x, pa.int64()) for x in out[4:])],
                names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, {'ids_crc32 long' if digest else 'ids array<int>'}, doc_tokens long, sequence_id long, offset long")
