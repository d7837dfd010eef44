"""Suffix-array dedup of repeated byte strings.

A byte goes if a string of ``size`` bytes that covers it also starts in a
document with a smaller id. Equal strings have to meet before suffixes can be
sorted, wherever they stand, so every window of ``size`` bytes is dealt by its
anchor: the smallest hash of the short grams inside it. Neighbouring windows
mostly share their anchor, and a run of them is one segment.

1. Texts are gathered in blocks of a few megabytes; every block announces the
   anchors it has, as hashes dealt to buckets.
2. A bucket answers each block which of its anchors other blocks have too.
3. Blocks send the segments of shared anchors, equal ones once, with the
   smallest id that has them.
4. A bucket cuts the segments of each anchor that has several different ones
   to what any two of them share around it, sorts the suffixes of what is left,
   finds windows that are equal, and answers the smallest id.
   Anchors with many different segments, as at the borders of a passage that
   a third of all documents share, are dealt by the digests of their windows
   instead: a block sends each window once, so no anchor meets in one task.
5. Blocks mark what smaller ids have and cut it out.

Suffixes are sorted by linear grouping: groups of suffixes with a common
Lyndon prefix are processed from the highest to the lowest, pointers to the
previous smaller suffix tell whose prefix a group extends, and the final
groups, in ascending order, are then filled from the suffixes that follow
their prefixes.

Number and size of blocks and buckets follow the bytes of the input; blocks
travel compressed.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ceil_div, stage
from emberlog.session import Staged

# workers need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 50
GRAM = 20
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: bytes of segments whose suffixes are sorted at a time
SORT_BYTES = 1 << 20
#: different segments from which an anchor is dealt window by window; a block
#: counts those of an anchor from SOME_SEGMENTS on, and else announces one
HOT_SEGMENTS, SOME_SEGMENTS = 2048, 16
#: bytes that are hashed at a time, so that the passes stay in the cache
CHUNK = 1 << 17

_ROWS = "block bigint, bucket bigint, data binary"
_NONE = -(1 << 63)


def _packed(value) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def _unpacked(data: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order."""
    n = len(text)
    if not n:
        return []
    # groups in a list linked downwards and upwards; at first one per byte
    present = sorted(set(text))
    members: list[list[int]] = [[] for _ in present]
    number = {c: g for g, c in enumerate(present)}
    group = [number[c] for c in text]
    for i, g in enumerate(group):
        members[g].append(i)
    lower, upper = list(range(-1, len(present) - 1)), [*range(1, len(present)), -1]
    length, done = [1] * len(present), [False] * len(present)
    previous = [-1] * n
    current = len(present) - 1
    while current >= 0:
        done[current] = True
        hits: dict[int, int] = {}
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        # the prefix of p grows by the current one, as often as it was hit;
        # more repetitions are higher, and all are above the rest of the group
        by: dict[tuple[int, int], list[int]] = {}
        for p, times in hits.items():
            by.setdefault((-times, group[p]), []).append(p)
        for (times, old), grown in sorted(by.items()):
            new = len(members)
            members.append(grown)
            length.append(length[old] - times * length[current])
            done.append(False)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            lower[above] = new  # a group that grows is never the highest
            for p in grown:
                group[p] = new
        members[current] = own
        current = lower[current]

    # ascending: every suffix is its prefix and a smaller suffix, which is
    # placed before, so members come in the order of what follows them
    bottom = 0
    while lower[bottom] >= 0:
        bottom = lower[bottom]
    place, at, g = [0] * len(members), 0, bottom
    while g >= 0:
        place[g] = at
        at += len(members[g]) if done[g] else 0
        g = upper[g]
    order = [-1] * n

    def emit(end: int) -> None:
        j = end - 1
        while j >= 0:
            g = group[j]
            if j + length[g] != end:
                break
            order[place[g]] = j
            place[g] += 1
            j = previous[j]

    emit(n)
    for i in range(n):
        emit(order[i])
    return order


def anchors(body: np.ndarray, lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Segments of a block: (document index, first window, last window, anchor).

    ``body`` holds the documents one after the other. Every window of ``size``
    bytes inside a document belongs to exactly one segment, and its anchor
    depends on its bytes alone."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out: list[tuple] = []
    grams = size - GRAM + 1
    at, n_docs = 0, len(lengths)
    while at < n_docs:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        if b - a >= size:
            low = _smallest(body[a:b].astype(np.uint64), grams)
            doc = np.repeat(np.arange(at, to), lengths[at:to])[: len(low)]
            inside = a + np.arange(len(low)) + size <= ends[doc]
            new = np.empty(len(low), dtype=bool)
            new[0] = True
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            where = np.flatnonzero(inside)
            if len(where):
                first = np.flatnonzero(new[where])
                last = np.concatenate([first[1:] - 1, [len(where) - 1]])
                out.append((doc[where[first]], where[first] + a, where[last] + a, low[where[first]]))
        at = to
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes."""
    base = 0x9E3779B97F4A7C15
    h, powers = {1: x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)}, 1
    while 2 * powers <= GRAM:
        factor = np.uint64(pow(base, powers, 1 << 64))
        h[2 * powers] = h[powers][:-powers] * factor + h[powers][powers:]
        powers *= 2
    full, have, rest = h[powers], powers, GRAM - powers
    while rest:
        part = 1 << (rest.bit_length() - 1)
        factor = np.uint64(pow(base, part, 1 << 64))
        tail = h[part][have:]
        full = full[: len(tail)] * factor + tail
        have, rest = have + part, rest - part
    full = full ^ (full >> np.uint64(31))
    full = full * np.uint64(0x94D049BB133111EB)
    full = full ^ (full >> np.uint64(29))
    return full


def _smallest(x: np.ndarray, grams: int) -> np.ndarray:
    """Smallest gram hash of every window."""
    low, wide = _gram_hashes(x), 1
    while 2 * wide <= grams:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < grams:
        low = np.minimum(low[: len(low) - (grams - wide)], low[grams - wide :])
    return low


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    # the small hashes win, so the high bits say little
    return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, distinct keys in ascending order) of a block."""
    keys = np.unique(keys)
    bucket = _buckets(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(keys, cuts), bucket[np.concatenate([[0], cuts])] if len(keys) else ()):
        yield int(b), part


def _many_segments(body: bytes, first: np.ndarray, last: np.ndarray, keys: np.ndarray, size: int) -> dict[int, int]:
    """Anchors with many different segments in a block, and how many."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    out = {}
    for run in np.flatnonzero(ends - starts >= SOME_SEGMENTS).tolist():
        at = order[starts[run] : ends[run]]
        n = len({body[a : z + size] for a, z in zip(first[at].tolist(), last[at].tolist())})
        if n >= SOME_SEGMENTS:
            out[int(keys[at[0]])] = n
    return out


def _blocks(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """Bucket -1: a block's documents. Others: the number of anchors of a block,
    the anchors, and those with many different segments with how many."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            body = b"".join(texts)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            rows = [(made, -1, _packed((ids[:], lengths, body)))]
            _, first, last, keys = anchors(np.frombuffer(body, dtype=np.uint8), lengths, size)
            many = _many_segments(body, first, last, keys, size)
            heavy = np.array(sorted(many), dtype=np.uint64)
            counts = np.array([many[k] for k in sorted(many)], dtype=np.uint64)
            whose = _buckets(heavy, buckets)
            for b, part in _dealt(keys, buckets):
                number = np.array([len(part)], dtype=np.uint64)
                rows.append((made, b, np.concatenate([number, part, heavy[whose == b], counts[whose == b]]).tobytes()))
            made, held = made + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.binary()),
            ], names=["block", "bucket", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(_NONE if doc is None else doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield flush()
        if texts:
            yield flush()

    return docs.mapInArrow(task, _ROWS)


def _answer_shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Which anchors of each block another block has, and which are hot, as bits."""
    sent = [np.frombuffer(d, dtype=np.uint64) for d in frame["data"]]
    parts = [x[1 : 1 + int(x[0])] for x in sent]
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    segments = counts.copy()
    for x in sent:
        heavy, many = np.split(x[1 + int(x[0]) :], 2)
        segments[np.searchsorted(keys, heavy)] += many.astype(np.int64) - 1
    several, hot = keys[counts > 1], keys[segments >= HOT_SEGMENTS]
    bits = [(np.isin(p, several, assume_unique=True), np.isin(p, hot, assume_unique=True)) for p in parts]
    some = [bool(b.any() or h.any()) for b, h in bits]
    return pd.DataFrame({
        "block": frame["block"][some], "bucket": frame["bucket"][some],
        "data": [np.packbits(b).tobytes() + np.packbits(h).tobytes() for (b, h), s in zip(bits, some) if s],
    })


def _shared_segments(ids: list[int], lengths, body: bytes, masks: dict[int, bytes], buckets: int, size: int):
    """Segments whose anchor another document has: positions, and for each the
    number of its distinct text; the texts with their anchor, smallest id, and
    whether the anchor is hot."""
    doc, first, last, key = anchors(np.frombuffer(body, dtype=np.uint8), lengths, size)
    keys, inverse = np.unique(key, return_inverse=True)
    shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for b, part in _dealt(key, buckets):
        if b in masks:
            for mask, half in zip((shared, hot), np.split(np.frombuffer(masks[b], dtype=np.uint8), 2)):
                bits = np.unpackbits(half, count=len(part)).astype(bool)
                mask[np.searchsorted(keys, part[bits])] = True
    if len(keys):  # several documents of this block
        low, high = np.full(len(keys), len(ids)), np.full(len(keys), -1)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        shared |= high > low
    take = shared[inverse] if len(keys) else np.zeros(0, dtype=bool)
    doc, first, last, key = doc[take], first[take], last[take], key[take]
    number: dict[bytes, int] = {}
    smallest: list[int] = []
    anchor: list[int] = []
    which = np.empty(len(doc), dtype=np.int64)
    for i, (d, a, z, k) in enumerate(zip(doc.tolist(), first.tolist(), last.tolist(), key.tolist())):
        text = body[a : z + size]
        e = number.setdefault(text, len(smallest))
        if e == len(smallest):
            smallest.append(ids[d])
            anchor.append(k)
        elif ids[d] < smallest[e]:
            smallest[e] = ids[d]
        which[i] = e
    anchors_of = np.array(anchor, dtype=np.uint64)
    is_hot = np.isin(anchors_of, keys[hot])
    return (doc, first, last, which), list(number), np.array(smallest, dtype=np.int64), anchors_of, is_hot


def _windows(segments: list[bytes], smallest: np.ndarray, size: int):
    """The different windows of some segments: numbers of each segment's
    windows, 128-bit digests, the smallest id of a segment that has them."""
    number: dict[bytes, int] = {}
    least: list[int] = []
    of = []
    for text, i in zip(segments, smallest.tolist()):
        own = []
        for a in range(len(text) - size + 1):
            w = number.setdefault(text[a : a + size], len(least))
            if w == len(least):
                least.append(i)
            elif i < least[w]:
                least[w] = i
            own.append(w)
        of.append(np.array(own, dtype=np.int64))
    digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in number)
    return of, np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2), np.array(least, dtype=np.int64)


def _send_segments(buckets: int, size: int):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        texts = frame[frame["bucket"] == -1]
        masks = dict(zip(frame["bucket"], frame["data"]))
        masks.pop(-1, None)
        ids, lengths, body = _unpacked(texts["data"].iloc[0])
        places, segments, smallest, anchor, hot = _shared_segments(ids, lengths, body, masks, buckets, size)
        dealt = np.flatnonzero(hot)
        of, digests, least = _windows([segments[e] for e in dealt.tolist()], smallest[dealt], size)
        rows = [(block, -2, _packed((*places, smallest, dealt, of, least)))] if segments else []
        bucket = np.where(hot, -1, _buckets(anchor, buckets))
        for b in np.unique(bucket[~hot]).tolist():
            at = np.flatnonzero(bucket == b)
            rows.append((block, b, _packed((at, anchor[at], smallest[at], [segments[i] for i in at.tolist()]))))
        bucket = _buckets(digests[:, 0], buckets)
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            rows.append((block, buckets + b, _packed((at, digests[at], least[at]))))
        return pd.DataFrame(rows, columns=["block", "bucket", "data"])

    return task


def smallest_owners(segments: list[tuple[bytes, int]], size: int = SIZE) -> list[np.ndarray]:
    """For every window of every segment (text, id), the smallest id of a
    segment that has an equal window."""
    body = b"\x00".join(text for text, _ in segments) + b"\x00"
    lengths = np.array([len(text) for text, _ in segments])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    windows = lengths - size + 1
    whose = np.repeat(np.arange(len(segments)), lengths + 1)
    order = np.array(suffix_array(body), dtype=np.int64)
    order = order[order - starts[whose[order]] < windows[whose[order]]]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, dtype=np.uint8), size)
    new = np.ones(len(order), dtype=bool)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        new[at:to] = (view[order[at:to]] != view[order[at - 1 : to - 1]]).any(axis=1)
    ids = np.array([i for _, i in segments], dtype=np.int64)[whose[order]]
    group = np.flatnonzero(new)
    owner = np.empty(len(body), dtype=np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(ids, group), np.diff(np.concatenate([group, [len(order)]])))
    return [owner[s : s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _reaches(texts: list[bytes]) -> list[int]:
    """Longest common start of each text with any of the others."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        n = _common(texts[i], texts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def anchor_places(segments: list[bytes], anchor: list[int]) -> list[int]:
    """Where the only gram with the anchor's hash starts in each segment; -1
    where there are several, as in periodic texts."""
    lengths = np.array([len(t) for t in segments])
    starts = np.cumsum(lengths) - lengths
    hashes = _gram_hashes(np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.uint64))
    whose = np.repeat(np.arange(len(segments)), lengths)[: len(hashes)]
    hit = np.flatnonzero(hashes == np.array(anchor, dtype=np.uint64)[whose])
    hit = hit[hit + GRAM <= starts[whose[hit]] + lengths[whose[hit]]]
    count = np.bincount(whose[hit], minlength=len(segments))
    out = np.full(len(segments), -1)
    out[whose[hit]] = hit - starts[whose[hit]]
    out[count != 1] = -1
    return out.tolist()


def owners_of(groups: list[tuple[int, list[tuple[bytes, int]]]], size: int = SIZE) -> dict[bytes, np.ndarray]:
    """For the windows of segments (text, id) grouped by anchor, the smallest
    id of an equal window; segments that own all of theirs are left out.

    Equal windows have their anchor at the same place, so they cannot reach
    further from it than two segments of the group agree to its left and to its
    right. What is left after cutting the segments to that is sorted."""
    flat = [(t, k) for k, group in groups for t, _ in group]
    places = iter(anchor_places([t for t, _ in flat], [k for _, k in flat]))
    out: dict[bytes, np.ndarray] = {}
    pieces: list[list[tuple[bytes, int, int]]] = []  # per group: cut text, first window, id
    for _, group in groups:
        at = [next(places) for _ in group]
        if min(at) < 0:
            pieces.append([(t, 0, i) for t, i in group])
            continue
        left = _reaches([t[:p][::-1] for (t, _), p in zip(group, at)])
        right = _reaches([t[p + GRAM :] for (t, _), p in zip(group, at)])
        pieces.append([(t[p - x : p + GRAM + y], p - x, i) for (t, i), p, x, y in zip(group, at, left, right)])
    waiting: list[tuple[bytes, int]] = []
    distinct: list[dict[bytes, int]] = []
    for group in pieces:
        least: dict[bytes, int] = {}
        for text, _, i in group:
            if len(text) >= size:
                least[text] = min(i, least.get(text, i))
        distinct.append(least)
        if len(least) > 1:
            waiting += least.items()
    sorted_owners = iter(smallest_owners(waiting, size) if waiting else ())
    for (_, group), cut, least in zip(groups, pieces, distinct):
        owner = {t: next(sorted_owners) for t in least} if len(least) > 1 else {t: np.full(len(t) - size + 1, i) for t, i in least.items()}
        for (text, i), (piece, first, _) in zip(group, cut):
            if piece in owner and (owner[piece] != i).any():
                own = np.full(len(text) - size + 1, i, dtype=np.int64)
                own[first : first + len(piece) - size + 1] = owner[piece]
                out[text] = own
    return out


def _answer_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """The windows of each block that a smaller id has elsewhere."""
    sent = [_unpacked(d) for d in frame["data"]]
    digests, ids = np.concatenate([d for _, d, _ in sent]), np.concatenate([i for _, _, i in sent])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    group = np.flatnonzero(new)
    owner = np.empty(len(ids), dtype=np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(ids[order], group), np.diff(np.append(group, len(order))))
    rows, done = [], 0
    for block, (at, _, least) in zip(frame["block"].tolist(), sent):
        own = owner[done : done + len(at)]
        done += len(at)
        changed = own < least
        if changed.any():
            rows.append((block, -4, _packed((at[changed], own[changed]))))
    return pd.DataFrame(rows, columns=["block", "bucket", "data"])


def _answer_owners(size: int, buckets: int):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] >= buckets:
            return _answer_windows(frame)
        least: dict[bytes, int] = {}
        by_anchor: dict[int, list[bytes]] = {}
        sent = [_unpacked(d) for d in frame["data"]]
        for _, anchor, smallest, texts in sent:
            for k, i, text in zip(anchor.tolist(), smallest.tolist(), texts):
                old = least.get(text)
                if old is None:
                    by_anchor.setdefault(k, []).append(text)
                    least[text] = i
                elif i < old:
                    least[text] = i
        # anchors with different segments, several of them at a time
        owners: dict[bytes, np.ndarray] = {}
        waiting: list[tuple[int, list[tuple[bytes, int]]]] = []
        held = 0
        for k, texts in by_anchor.items():
            if len(texts) > 1:
                waiting.append((k, [(t, least[t]) for t in texts]))
                held += sum(map(len, texts))
                if held >= SORT_BYTES:
                    owners |= owners_of(waiting, size)
                    waiting, held = [], 0
        if waiting:
            owners |= owners_of(waiting, size)
        rows = []
        for block, (at, _, smallest, texts) in zip(frame["block"].tolist(), sent):
            changed = [
                (e, owners.get(t, least[t])) for e, i, t in zip(at.tolist(), smallest.tolist(), texts)
                if t in owners or least[t] < i
            ]
            if changed:
                rows.append((block, -3, _packed(changed)))
        return pd.DataFrame(rows, columns=["block", "bucket", "data"])

    return task


def _cut(size: int, with_text: bool):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = {b: d for b, d in zip(frame["bucket"], frame["data"]) if b > -3}
        ids, lengths, body = _unpacked(kinds[-1])
        covered = np.zeros(len(body) + 1, dtype=np.int32)
        if -2 in kinds:
            doc, first, last, which, owner, dealt, of, least = _unpacked(kinds[-2])
            for data in frame["data"][frame["bucket"] == -4]:
                at, own = _unpacked(data)
                least[at] = own
            uneven: dict[int, np.ndarray] = {e: least[w] for e, w in zip(dealt.tolist(), of)}
            for data in frame["data"][frame["bucket"] == -3]:
                for e, own in _unpacked(data):
                    if isinstance(own, np.ndarray):
                        uneven[e] = own
                    else:
                        owner[e] = own
            mine = np.array(ids, dtype=np.int64)[doc]
            plain = np.ones(len(owner), dtype=bool)
            plain[list(uneven)] = False
            gone = plain[which] & (owner[which] < mine)
            np.add.at(covered, first[gone], 1)
            np.add.at(covered, last[gone] + size, -1)
            for i in np.flatnonzero(~plain[which]).tolist():
                at = first[i] + np.flatnonzero(uneven[int(which[i])] < mine[i])
                np.add.at(covered, at, 1)
                np.add.at(covered, at + size, -1)
        removed = np.cumsum(covered[:-1]) > 0
        ends = np.cumsum(lengths)
        raw = np.frombuffer(body, dtype=np.uint8)
        rows = []
        for i, n, z in zip(ids, lengths.tolist(), ends.tolist()):
            cut = removed[z - n : z]
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            left = raw[z - n : z][~cut].tobytes() if spans else body[z - n : z]
            row = (None if i == _NONE else i, n, int(cut.sum()), spans, hashlib.sha256(left).hexdigest())
            rows.append((*row, left) if with_text else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        out = pd.DataFrame(rows, columns=names[: 5 + with_text])
        return out.astype({"doc_id": "Int64"})

    return task


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, with_text: bool = False
) -> DataFrame:
    """One row per input row: bytes, removed bytes and runs, hash of the rest
    (and the rest itself, as bytes, with ``with_text``).

    Null text counts as empty. Rows that repeat an id do not count as earlier
    for each other; a null id is smaller than all others. Ids are whole
    numbers. Other columns are not used.
    """
    if size <= GRAM:
        raise ValueError(f"windows have more than {GRAM} bytes")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = ceil_div(total, BUCKET_BYTES)
    # what a step alone has read is given up after it, so that only the texts,
    # their marks and the narrow answers are there at the end
    blocks = Staged(_blocks(rows, buckets, size), "bucket >= 0")
    texts = blocks.part(False)
    shared = stage(blocks.part(True).groupBy("bucket").applyInPandas(_answer_shared, _ROWS))
    blocks.drop(True)
    sent = Staged(texts.union(shared).groupBy("block").applyInPandas(_send_segments(buckets, size), _ROWS), "bucket >= 0")
    owners = stage(sent.part(True).groupBy("bucket").applyInPandas(_answer_owners(size, buckets), _ROWS))
    sent.drop(True)
    whole = texts.union(sent.part(False)).union(owners)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = whole.groupBy("block").applyInPandas(_cut(size, with_text), schema + (", kept binary" if with_text else ""))
    return out.withColumnRenamed("doc_id", id_col)
