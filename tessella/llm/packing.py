"""Packing along a space-filling curve.

Each document's words are hashed and projected to ``DIMS`` dimensions; the
direction of the projected vector is a point in a cube and its place on the
Hilbert curve is the document's key. Rows are range-sorted by key, so documents
that use the same words lie near each other, and each range is packed as one
stream: its token ids (each document closed by an end id) are cut every ``SIZE``
ids. What is left at the end of a range is cut into sequences whose lengths are
powers of two, which need no padding, so ranges never wait for each other.

Scale: one shuffle, of the texts, by (key, id); equal keys are told apart by id,
so a group of copies that holds a third of all rows is still dealt over many
ranges. Keys are computed from bytes by vectorised hashing, so that the sampling
pass of the range sort costs little; texts are tokenized once, after it. A task
holds one Arrow batch and less than one sequence.

Edge cases: null text counts as empty; an empty text is the end id alone. A very
long text runs over as many sequences as it needs. Null ids sort first; ties in
key and id stay in one range. Repeated rows are packed once per row. Extra columns
are ignored. An empty table gives an empty result. A special token's string inside
a text becomes that token's id, as the file's own library has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytehash
from tessella.llm.common import portable

SIZE = 1024
END = 0
DIMS = 3
BITS = 16

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` per axis.

    Skilling's transformation of the coordinates to the transposed index, for
    all points at once, then the interleaving of the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Curve places of a batch's texts; texts without words lie at the cube's middle."""
    out = np.zeros((len(offsets) - 1, dims))
    for i, j, b, at in bytehash.chunks(data, offsets):
        h, doc = bytehash.word_hashes(bytehash.LOWER[b], at)
        for d in range(dims):
            # 16 bits of the hash as a value from -1 to 1: a random projection of the hashed word
            v = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32767.5 - 1
            out[i:j, d] = np.bincount(doc, weights=v, minlength=j - i)
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    unit = out / np.where(length > 0, length, 1)
    return hilbert(np.minimum(((unit + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


class Encoder:
    """A byte-level BPE vocabulary file as an encoder of texts to ids.

    Where each merge's id follows the ids of the merges before it, merging by
    rank and merging by id are the same, and a faster engine than the file's own
    library gives the same ids; otherwise the file's own library is used.
    """

    def __init__(self, content: str):
        model = json.loads(content)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        split = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = [vocab.get(a + b, -1) for a, b in split]
        pre = model.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("normalizer") is None
        added = model.get("added_tokens") or []
        # added tokens are cut out of a text before anything else if they have no rules of their own
        plain = plain and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        self.fast = None
        if plain and ranked == sorted(ranked) and ranked[0] >= 256:
            import tiktoken

            special = {t["content"]: t["id"] for t in added}
            letters = self._letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(content)

    @staticmethod
    def _letters() -> dict[str, int]:
        """The byte that each letter of a byte-level vocabulary stands for."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out = {chr(b): b for b in plain}
        return out | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Cuts a stream of documents into sequences; ``rows`` collects the pieces."""

    def __init__(self, first_id: int, size: int):
        self.id, self.size, self.rows = first_id, size, []
        self.open: list[tuple] = []
        self.used = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while start < n:
            m = min(n - start, self.size - self.used)
            piece = (doc_id, start, m, ids[start : start + m], n)
            start += m
            self.open.append(piece)
            self.used += m
            if self.used == self.size:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, m, ids, n in pieces:
            self.rows.append((doc_id, start, m, ids.astype("<u4").tobytes(), n, self.id, at))
            at += m
        self.id += 1

    def finish(self) -> None:
        """Cut the rest at powers of two, the largest first."""
        rest, left = self.open, self.used
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                doc_id, start, m, ids, n = rest[0]
                if m <= room:
                    now.append(rest.pop(0))
                    room -= m
                else:
                    now.append((doc_id, start, room, ids[:room], n))
                    rest[0] = (doc_id, start + room, m - room, ids[room:], n)
                    room = 0
            self._close(now)
        self.open, self.used = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is the path of a byte-level BPE file; the driver reads it and
    broadcasts its content. ``ids`` are little-endian 32-bit. The sequence size
    is a power of two.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("long")
    def place(texts: pa.Array) -> pa.Array:
        return pa.array(curve_keys(*bytehash.text_bytes(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(content.value)
        packer = Packer(TaskContext.get().partitionId() << 40, size)
        tail = np.array([end], np.uint32)
        for batch in batches:
            held = 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([encode(t.as_py() or ""), tail])
                packer.add(i, ids)
                held += len(ids)
                if held > 1 << 18:
                    yield packer.batch()
                    held = 0
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("place", place("text"))
    ordered = rows.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ordered.select("doc_id", "text").mapInArrow(run, PIECES)


portable(__name__)
