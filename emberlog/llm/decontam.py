"""Benchmark decontamination: CGK random walks, bit sampling, exact edit check.

A document leaks an item if some run of its words, of whatever length, is
within a word edit distance of a fifth of the item's length (similarity 0.8).

``Walks`` embeds item-sized windows so that edit distance becomes Hamming
distance, and samples places of the embeddings as keys; a window that has a key
of an item is a candidate for it. Around every place the item could stand at,
all windows that begin up to the allowed edits away are embedded, also those
that a document's end cuts short, which are padded. For passages with as many
edits as allowed (items of 5 to 59 words, 300 of each length, 16 walks of 16
samples of three places) all were found, where 8 times 8 samples lost up to 7 in
1000; about 1 % of the places of other texts pass. A candidate goes through an
exact semi-global comparison with the item, over stretches of every length.

Before the walks stand sieves that lose no leak: with so many edits at least
one of as many chunks of the item, and one more, is whole, and it tells where
the item would stand; and enough of the words there must be known to the
benchmark, and to the item.

Items are the query set. They are sent to the tasks in blocks of at most
BLOCK_ITEMS items; every block sees all documents, which are not shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ceil_div, others_aside

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ITEMS = 20_000
SIMILARITY = 0.8
#: walks, samples of places per walk, places per sample
WALKS, TABLES, PLACES = 16, 16, 3
#: words of documents that a task looks at together, and places (or words of them) it compares
BATCH_WORDS, BATCH_PLACES = 2_000_000, 1 << 18
#: windows embedded at a time
BATCH_WINDOWS = 2048

LEAKS = "array<struct<item_id:bigint,start:bigint,words:bigint,distance:bigint>>"
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(round((1 - SIMILARITY) * n * 1000)) // 1000


def _gram_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words."""
    count = len(numbers) - size + 1
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out = (out + numbers[k : k + count].astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Walks:
    """CGK embeddings of windows of n words, and hashed samples of their places."""

    def __init__(self, n: int, seed: int = 0) -> None:
        rng = np.random.default_rng([seed, n])
        # a full embedding has 3 n steps; places are drawn from those that are
        # mostly inside the window, since all windows agree on what lies behind
        self.n, self.steps = n, max(PLACES, (8 * n + 4) // 5)
        self.bits = rng.integers(1, 2**63, size=(self.steps, WALKS), dtype=np.uint64) | np.uint64(1)
        self.places = np.stack([
            np.stack([rng.choice(self.steps, PLACES, replace=False) for _ in range(TABLES)]) for _ in range(WALKS)
        ])
        self.mix = rng.integers(1, 2**63, size=PLACES, dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(rows, WALKS * TABLES) hashes of ``windows`` (rows, n) of word numbers."""
        rows = len(windows)
        padded = np.hstack([windows, np.full((rows, 1), -2, dtype=np.int64)])
        row, walk = np.arange(rows)[:, None], np.arange(WALKS)[None, :]
        embedded = np.empty((self.steps, rows, WALKS), dtype=np.uint64)
        at = np.zeros((rows, WALKS), dtype=np.int64)
        for j in range(self.steps):
            symbol = (padded[row, at] + 3).astype(np.uint64)
            embedded[j] = symbol
            # a random bit for every pair of step and word
            at = np.minimum(at + ((symbol * self.bits[j] >> np.uint64(40)) & np.uint64(1)).astype(np.int64), self.n)
        out = np.empty((rows, TABLES, WALKS), dtype=np.uint64)
        for t in range(TABLES):
            key = np.zeros((rows, WALKS), dtype=np.uint64)
            for p in range(PLACES):
                key = (key ^ embedded[self.places[:, t, p][None, :], row, walk]) * self.mix[p]
                key ^= key >> np.uint64(29)
            out[:, t] = key
        return out.reshape(rows, TABLES * WALKS)

    def alike(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Rows of ``places`` (rows, width) in which some window of n columns,
        from one between ``low`` and ``high`` on, has a key of its item."""
        rows, width = places.shape
        kinds, which = np.unique(items, axis=0, return_inverse=True)
        wanted = self.keys(kinds)[which.ravel()]
        padded = np.hstack([places, np.full((rows, self.n), -2, dtype=np.int64)])
        found = np.zeros(rows, dtype=bool)
        for i in range(0, rows, max(1, BATCH_WINDOWS // width)):
            part = slice(i, i + max(1, BATCH_WINDOWS // width))
            first = np.arange(width)[None, :]
            row, start = np.nonzero((first >= low[part][:, None]) & (first < high[part][:, None]) & (first <= width - self.n))
            windows = padded[part][row[:, None], start[:, None] + np.arange(self.n)]
            same = (self.keys(windows) == wanted[part][row]).any(axis=1)
            found[part] |= np.bincount(row[same], minlength=len(found[part])) > 0
        return found


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of two (rows, n) arrays."""
    rows, n = a.shape
    before = np.tile(np.arange(n + 1), (rows, 1))
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        change = before[:, :-1] + (a[:, i : i + 1] != b)
        lower = np.minimum(change, before[:, 1:] + 1)
        for j in range(n):
            now[:, j + 1] = np.minimum(lower[:, j], now[:, j] + 1)
        before = now
    return before[:, n]


def closest_windows(places: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray) -> np.ndarray:
    """(rows, 3) of distance, start and words: for each row the stretch of the
    columns ``low`` to ``high`` of ``places`` (rows, width) with the least word
    edit distance to ``items`` (rows, n); of equals the first, then the shortest.

    A cell holds a distance and, in its low bits, where its stretch starts.
    Columns outside ``low`` and ``high`` have no partner in an item, so a
    stretch that enters them costs as much as the one that ends before."""
    (rows, width), n = places.shape, items.shape[1]
    unit = 1 << int(width).bit_length()
    steps = unit * np.arange(width + 1)[:, None]
    places, items = np.ascontiguousarray(places.T), items.T
    before = np.clip(np.arange(width + 1)[:, None], low, high)
    for i in range(n):
        now = before + unit
        np.minimum(now[1:], before[:-1] + unit * (places != items[i]), out=now[1:])
        now -= steps
        np.minimum.accumulate(now, axis=0, out=now)
        now += steps
        before = now
    end = before.argmin(axis=0)
    least = before[end, np.arange(rows)]
    start = least % unit
    return np.stack([least // unit, start, np.clip(end, low, high) - start], axis=1)


class Index:
    """Items by length, the chunks of which a leak holds one whole, and the
    walks of each length."""

    def walks(self, n: int) -> Walks:
        if n not in self._walks:
            self._walks[n] = Walks(n)
        return self._walks[n]

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self._walks: dict[int, Walks] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for item_id, words in items:
            if words:
                ids, rows = by_length.setdefault(len(words), ([], []))
                ids.append(item_id)
                rows.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        self.lengths = []
        # chunk length -> hashes of chunks with (item length, item, offset)
        chunks: dict[int, list[tuple]] = {}
        for k, n in enumerate(sorted(by_length)):
            ids, body = by_length[n][0], np.array(by_length[n][1], dtype=np.int64)
            size = n // (allowed(n) + 1)
            for at in range(0, size * (allowed(n) + 1), size):
                grams = np.array([_gram_hashes(row, size)[0] for row in body[:, at : at + size]], dtype=np.uint64)
                chunks.setdefault(size, []).append((grams, np.full(len(ids), k), np.arange(len(ids)), np.full(len(ids), at)))
            self.lengths.append((n, ids, body))
        self.chunks = []
        for size, found in chunks.items():
            grams, length, item, offset = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(grams, kind="stable")
            hashes, first = np.unique(grams[order], return_index=True)
            some = np.zeros(1 << 20, dtype=bool)
            some[hashes >> np.uint64(44)] = True
            self.chunks.append((size, hashes, np.append(first, len(order)), some, length[order], item[order], offset[order]))

    def _places(self, numbers: np.ndarray, known: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(length class, item, document, start) of where a whole chunk puts an item."""
        for size, hashes, first, some, length, item, offset in self.chunks:
            if len(numbers) < size:
                continue
            grams = _gram_hashes(numbers, size)
            at = np.flatnonzero(some[grams >> np.uint64(44)] & (known[size:] - known[:-size] == size))
            at = at[doc_of[at] == doc_of[at + size - 1]]
            which = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
            same = hashes[which] == grams[at]
            at, which = at[same], which[same]
            count = first[which + 1] - first[which]
            # hits of common chunks are spread over several rounds
            rounds = np.cumsum(count) // BATCH_PLACES
            cuts = np.flatnonzero(np.diff(rounds)) + 1
            for a, w, c in zip(np.split(at, cuts), np.split(which, cuts), np.split(count, cuts)):
                if len(a):
                    entry = np.repeat(first[w], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    yield length[entry], item[entry], np.repeat(doc_of[a], c), np.repeat(a, c) - offset[entry]

    def leaks(self, texts: list[list[str]]) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item, start word, words, distance): for every item that
        leaks, its closest window, the earliest of equals, then the shortest."""
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for words in texts for w in words], dtype=np.int64)
        sizes = np.array([len(words) for words in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        known = np.concatenate([[0], np.cumsum(numbers >= 0)])
        doc_of = np.repeat(np.arange(len(texts)), sizes)
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for length, item, doc, start in self._places(numbers, known, doc_of):
            for k in np.unique(length).tolist():
                n, ids, body = self.lengths[k]
                mine, most = length == k, allowed(n)
                at = np.unique(np.stack([item[mine], doc[mine], start[mine]], axis=1), axis=0)
                # around the place, as far as edits can move the ends
                low = np.maximum(at[:, 2] - most, (ends - sizes)[at[:, 1]])
                high = np.minimum(at[:, 2] + n + most, ends[at[:, 1]])
                at = at[known[high] - known[low] >= n - most]
                rows = max(1, min(4096, BATCH_PLACES // n))
                for i in range(0, len(at), rows):
                    self._compare(numbers, at[i : i + rows], n, most, ids, body, sizes, ends, best)
        return [sorted(found.values()) for found in best]

    def _compare(self, numbers, at, n, most, ids, body, sizes, ends, best) -> None:
        item, doc, left = at[:, 0], at[:, 1], at[:, 2] - most
        first = ends[doc] - sizes[doc]
        columns = left[:, None] + np.arange(n + 2 * most)
        inside = (columns >= first[:, None]) & (columns < ends[doc][:, None])
        places = np.where(inside, numbers[np.clip(columns, 0, len(numbers) - 1)], -2)
        # all but the edited words of the item are there
        there = np.zeros(item.shape, dtype=np.int64)
        for j in range(n):
            there += (places == body[item, j][:, None]).any(axis=1)
        able = np.flatnonzero(there >= n - most)
        if not len(able):
            return
        item, doc, left, first, places = item[able], doc[able], left[able], first[able], places[able]
        low = np.maximum(first - left, 0)
        high = np.minimum(ends[doc] - left, n + 2 * most)
        # equal places, as in copies, are compared once
        kinds, back = np.unique(np.column_stack([item, low, high, places]), axis=0, return_inverse=True)
        alike = self.walks(n).alike(kinds[:, 3:], kinds[:, 1], kinds[:, 2], body[kinds[:, 0]])
        close = np.full((len(kinds), 3), most + 1)
        if alike.any():
            kept = kinds[alike]
            close[alike] = closest_windows(kept[:, 3:], kept[:, 1], kept[:, 2], body[kept[:, 0]])
        close = close[back.ravel()]
        near = close[:, 0] <= most
        for i, d, x, (distance, start, words) in zip(
            item[near].tolist(), doc[near].tolist(), (left - first)[near].tolist(), close[near].tolist()
        ):
            found = (ids[i], x + start, words, distance)
            old = best[d].get(ids[i])
            if old is None or (distance, x + start, words) < (old[3], old[1], old[2]):
                best[d][ids[i]] = found


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """All columns plus ``out``: the items each row leaks, by item id.

    Words are runs of letters and digits, in lower case. Null and empty texts
    leak nothing; items without words, or with a null id, are passed over;
    items that repeat an id are searched one by one and reported as one.
    Repeated rows are judged one by one.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    blocks = ceil_div(items.count(), BLOCK_ITEMS)
    found = docs.withColumn(out, F.array().cast(LEAKS))
    for k in range(blocks):
        # a block of the query set; its size is bounded by BLOCK_ITEMS on average
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = _search(found, [(r["item_id"], words_of(r["text"])) for r in block], text, out)
    return found


def _search(docs: DataFrame, items: list[tuple[int, list[str]]], text: str, out: str) -> DataFrame:
    at, to = docs.columns.index(text), len(docs.columns) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)

        def judged(part: pa.RecordBatch) -> pa.RecordBatch:
            found = index.leaks([words_of(x.as_py()) for x in part.column(at)])
            kind = part.schema.field(to).type
            names = [kind.value_type.field(i).name for i in range(4)]
            old = part.column(to).to_pylist()
            new = [a + [dict(zip(names, x)) for x in b] for a, b in zip(old, found)]
            columns = [*part.columns[:to], pa.array(new, type=kind)]
            return pa.RecordBatch.from_arrays(columns, schema=part.schema)

        for batch in batches:
            first, size = 0, 0
            for i, length in enumerate(batch.column(at).to_pandas().str.len().fillna(0).astype(int)):
                size += length // 5 + 1
                if size >= BATCH_WORDS:
                    yield judged(batch.slice(first, i + 1 - first))
                    first, size = i + 1, 0
            if first < batch.num_rows:
                yield judged(batch.slice(first))

    return docs.mapInArrow(task, docs.schema)


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: what it leaks and how close the closest is."""
    rows = find_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark)
    leaks = F.col("leaks")
    return rows.select(
        F.col("doc_id").alias(id_col), (F.size(leaks) > 0).alias("contaminated"),
        F.size(leaks).cast("long").alias("n_items"),
        F.array_distinct(F.transform(leaks, lambda x: x["item_id"])).alias("items"),
        F.array_min(F.transform(leaks, lambda x: x["distance"])).alias("least_distance"),
        F.array_min(F.transform(leaks, lambda x: x["start"])).alias("first_start"),
    )


@others_aside("doc_id", "text")
def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    return find_leaks(docs, benchmark, out="__leaks").where(F.size("__leaks") == 0).select(*docs.columns)
