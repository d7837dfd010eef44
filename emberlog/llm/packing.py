"""Packing: minimum bin slack over the lengths that are left.

Each task tokenises its documents, cuts whole windows off them and keeps the
remainders in a pool. A window starts with the longest piece of the pool; a
bitset of reachable sums over the other lengths finds the multiset that fills
it closest to capacity, and walking the bitsets back gives the counts. Only
where no multiset fits exactly is a piece cut. What is left of a task goes
into windows of power-of-two lengths, which need no padding.

No rows move between tasks: the pool is bounded, so is the memory of a task,
and a task that is run again packs the same rows in the same way.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
#: id that ends a document
END_ID = 0
#: windows are filled while the pool holds more pieces than POOL_LOW, once it has POOL_HIGH
POOL_HIGH, POOL_LOW = 2048, 1024

PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "ids array<bigint>"
)


def encoder(name: str):
    """Token ids of a text by a vocabulary of the tokenizers library.

    The byte-level vocabulary also exists as ranks, whose encoder gives the
    same ids several times faster; a text that holds the string of the special
    token goes through the tokenizer itself, which gives it its own id.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow: list = []

    def by_tokenizer(text: str) -> list[int]:
        if not slow:
            slow.append(Tokenizer.from_file(public_tokenizers.path(name)))
        return slow[0].encode(text, add_special_tokens=False).ids

    if name != "byte_bpe_50k.json":
        return by_tokenizer
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return by_tokenizer(text) if "<|endoftext|>" in text else fast.encode_ordinary(text)

    return encode


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths (length -> count) with the largest sum <= room.

    Bit s of ``reach`` is set if some multiset of the copies seen so far sums
    to s. The search stops once the room is filled exactly; before that every
    copy of every length takes part."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            steps.append((length, reach))
            after = (reach | reach << length) & mask
            if after == reach:
                steps.pop()
                break
            reach = after
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:  # not reachable without this copy
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return chosen


class Packer:
    """Fills windows from a pool of pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.pool: dict[int, list] = {}
        self.size = 0
        self.out: list[tuple] = []

    def _put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.size += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.size -= 1
        return piece

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    @staticmethod
    def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:at], total), (doc, start + at, ids[at:], total)

    def add(self, doc, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        whole = n - n % cap
        for at in range(0, whole, cap):
            self._emit([(doc, at, ids[at : at + cap], n)])
        if whole < n:
            self._put((doc, whole, ids[whole:], n))
        if self.size >= POOL_HIGH:
            self.fill(POOL_LOW)

    def fill(self, down_to: int) -> None:
        """Fill windows while more than ``down_to`` pieces are left and there
        is enough for a whole window."""
        while self.size > down_to and sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            window = [self._take(max(self.pool))]
            room = self.capacity - len(window[0][2])
            if room:
                for length, n in best_fill({k: len(v) for k, v in self.pool.items()}, room).items():
                    window += [self._take(length) for _ in range(n)]
                    room -= n * length
            if room:  # no multiset fits: cut the shortest piece that fills the rest
                head, rest = self._cut(self._take(min(x for x in self.pool if x > room)), room)
                window.append(head)
                self._put(rest)
            self._emit(window)

    def finish(self) -> None:
        self.fill(0)
        rest = [p for k in sorted(self.pool, reverse=True) for p in self.pool[k]]
        self.pool, self.size = {}, 0
        left = sum(len(p[2]) for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                piece = rest.pop(0)
                if len(piece[2]) > room:
                    piece, more = self._cut(piece, room)
                    rest.insert(0, more)
                window.append(piece)
                room -= len(piece[2])
            self._emit(window)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it comes from, where it goes, and its ids.

    Null and empty texts have the end id only. Repeated rows and ids are
    packed one by one; other columns are not used. Windows have ``capacity``
    ids, but for the last few of a task, whose lengths are powers of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    columns = PIECES if with_ids else PIECES.rpartition(",")[0]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        id_type = None

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array([r[i] for r in rows], type=id_type if i == 0 else pa.int64()) for i in range(7)]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([r[7].astype(np.int64) for r in rows], type=pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            # ids by slices, so that a batch of long texts is not held twice
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, body in zip(part.column(0).to_pylist(), part.column(1)):
                    packer.add(doc, np.array([*encode(body.as_py()), END_ID], dtype="<u4"))
                if len(packer.out) >= 4096:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return rows.mapInArrow(task, f"doc_id {kind}, {columns}")
