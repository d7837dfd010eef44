import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity=1024):
    """docs: Counter of (id, ids)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0  # no padding is needed
    for (doc, ids), copies in docs.items():
        ids = np.array(ids, dtype="<u4")
        own = [r for r in pieces[doc] if r["doc_tokens"] == len(ids)]
        starts = Counter(r["start"] for r in own)
        assert sum(r["length"] for r in own) == copies * len(ids) and starts[0] >= copies
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    return sequences


def test_query(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    docs = Counter((r["doc_id"], tuple(ids_of(r["text"]))) for r in texts)
    sequences = check(queries.op5_packing(spark, FOLDER).collect(), docs)
    total = sum(len(ids) * n for (_, ids), n in docs.items())
    assert len(sequences) <= total / 1024 + 12 * 8


def test_round_trip_and_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "long " * 20_000), (5, "<|endoftext|> x"), (6, "é\x00\n𝕏")]
    rows = [(i, t, 0, "x") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, length string")
    got = packing.pack(docs).collect()
    check(got, Counter((i, tuple(ids_of(t))) for i, t in texts))
    whole = sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["start"])
    assert [x for r in whole for x in r["ids"]] == ids_of("long " * 20_000)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 64))
def test_best_fill_is_the_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.best_fill(dict(counts), room)
    assert all(0 < n <= counts[x] for x, n in chosen.items())
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_matches_the_tokenizer(text):
    encode = test_encoder_matches_the_tokenizer.encode
    assert encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


test_encoder_matches_the_tokenizer.encode = packing.encoder("byte_bpe_50k.json")
