"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import random
import struct
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import byte_bpe, packing, token_counts, wordbpe
from shelfwise.llm.hashing import constants
from shelfwise.llm.perfect_hash import PerfectHash
from tests.llm.helpers import TEXTS, table

HARD = [t or "" for _, t in TEXTS] + ["İstanbul ſtraße é", "a<|endoftext|>b it's WE'LL", "x\x85y​z \x1c a\x1db", "'s don't 'S !!'s $$$%", "école ﬁ 😀😀", "ŉ ĿL·L"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranked():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def unpacked(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_ids_and_counts_match_the_library(library):
    counts = token_counts.prefix_counts()
    for text in HARD:
        want = ids(library, text)
        assert unpacked(wordbpe.encode(token_counts.VOCABULARY, text)) == want
        assert counts.total(text) == len(want)


def test_every_prefix_has_its_exact_count(library):
    counts, rng = token_counts.prefix_counts(), random.Random(3)
    for text in HARD:
        for n in range(len(text) + 1) if len(text) < 120 else rng.sample(range(len(text)), 3):
            assert counts.at(text, n) == len(ids(library, text[:n])), (text[:n])


def test_fitting_keeps_whole_pretokens_within_the_budget(library):
    counts = token_counts.prefix_counts()
    for text in HARD:
        for budget in (0, 1, 5, 50):
            n = counts.fitting(text, budget)
            assert len(ids(library, text[:n])) <= budget
            assert n == len(text) or len(ids(library, text)) > budget


def test_stored_counts_and_longest_prefixes(library):
    counts = token_counts.prefix_counts()
    hard = ["e\u0301cole o\u0323\u0302 q\u0307\u0323x", "\u1112\u1161\u11ab\u1100\u1173\u11af", "we'll they've you're'", "!!<|endoftext|>!!", "İİ ŉ'ŉ", "日本" * 60, "xq" * 40 + " 😀😀é", "e\u0301" * 50]
    for text in [*HARD, *hard]:
        if len(text) > 200:
            continue
        want = [len(ids(library, text[:n])) for n in range(len(text) + 1)]
        assert counts.every(text) == want, text
        assert [counts.at(text, n) for n in range(len(text) + 1)] == want
        for budget in (0, 1, 2, 5, 9, 30):
            assert counts.fitting(text, budget) == max(n for n, c in enumerate(want) if c <= budget)
    for run in ("x" * 12_000, "日" * 5_000, "e\u0301" * 3_000):
        n = counts.fitting(run, 2048)
        assert n and len(ids(library, run[:n])) <= 2048 < len(ids(library, run[:n + 1]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abelrv'!\u0301\u0323 <|>İΣ日1"), max_size=25))
def test_random_prefixes(library, text):
    assert token_counts.prefix_counts().every(text) == [len(ids(library, text[:n])) for n in range(len(text) + 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrstäéß'!3 \n<|>\\Σ日"), max_size=60))
def test_random_texts(library, ranked, text):
    assert unpacked(wordbpe.encode(token_counts.VOCABULARY, text)) == ids(library, text)
    assert token_counts.prefix_counts().total(text) == len(ids(library, text))
    bpe = byte_bpe.byte_bpe()
    got = bpe.encode([text])[0]
    assert got.tolist() == ranked.encode_ordinary(text) and bpe.decode(got) == text.encode()


def test_count_table(spark, library):
    got = token_counts.count_tokens(table(spark)).collect()
    assert len(got) == len(TEXTS)
    want = sorted(((i, len((t or "").encode()), n := len(ids(library, t or "")), n > 2048) for i, t in TEXTS), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got), key=str) == want
    assert token_counts.count_tokens(table(spark, [])).count() == 0
    tables = token_counts.prefix_tables(table(spark))
    stored = {r["doc_id"]: r for r in tables.collect()}
    assert stored[4]["counts"] == [0] and stored[1]["counts"] == [len(ids(library, TEXTS[0][1][:n])) for n in range(len(TEXTS[0][1]) + 1)]
    cuts = {r["doc_id"]: r for r in tables.select("doc_id", token_counts.tokens_at(F.col("counts"), F.lit(7)).alias("seven"), token_counts.fit_chars(F.col("counts"), F.lit(5)).alias("five")).collect()}
    counts = token_counts.prefix_counts()
    assert all(cuts[i]["seven"] == len(ids(library, (t or "")[:7])) and cuts[i]["five"] == counts.fitting(t or "", 5) for i, t in TEXTS if i is not None)


def test_perfect_hash_is_minimal():
    keys = np.unique(constants(5000, 1))
    found = PerfectHash(keys)(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        PerfectHash(np.array([3, 3], np.uint64))


def test_byte_bpe_matches_the_library(ranked):
    bpe = byte_bpe.ByteBpe()
    for text, got in zip(HARD, bpe.encode(HARD)):
        assert got.tolist() == ranked.encode_ordinary(text) and bpe.decode(got) == text.encode()
    assert bpe.encode([]) == []


def test_byte_bpe_tables(spark, ranked):
    got = byte_bpe.digests(table(spark)).collect()
    assert len(got) == len(TEXTS) and all(r["round_trip"] for r in got)
    want = sorted((str(i), sha256(np.array(ranked.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in got) == want
    back = byte_bpe.decode(byte_bpe.encode(table(spark))).collect()
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in TEXTS)
    assert byte_bpe.digests(table(spark, [])).count() == 0


def test_packing_holds_every_id_once(spark, library):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 13] + [(100 + i, "some more words to pack " * (i % 40)) for i in range(300)]
    got = packing.pack(table(spark, rows).repartition(3)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        all_ids = ids(library, t or "") + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = np.array(all_ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(all_ids)
            at += r["length"]
        assert at == len(all_ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark), window=1000)


def test_packing_keeps_repeated_and_unnamed_rows(spark):
    got = packing.pack(table(spark)).collect()
    assert sum(r["start"] == 0 for r in got) == len(TEXTS)


def test_sum_of_squares_rule():
    """Each placement leaves the least sum of squared level counts among all allowed ones."""
    rng, packer = random.Random(5), packing.Packer(window=16)
    for step in range(400):
        size, before = rng.randrange(1, 16), packer.level.copy()
        options = []
        for h in [0] + [h for h in range(1, 17 - size) if before[h]]:
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            options.append(int((after ** 2).sum()))
        packer.place((step, 0, b"", 0), size)
        assert int((packer.level ** 2).sum()) == min(options)
