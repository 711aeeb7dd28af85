"""Exact and near duplicates and fingerprints against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import exact_dedup, fingerprints, hashing, near_dedup
from shelfwise.llm.components import components
from tests.llm.helpers import TEXTS, near_components, shingle_set, table


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(least[normalised(t)]), len(groups[normalised(t)]), sha256(normalised(t).encode()).hexdigest()) for i, t in rows)


def copies(seed, n):
    """A third of the rows are copies of one text, others come in small groups with a long common beginning."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        out.append((i, "same text\tall over" if kind < 0.33 else "beginning " * 20 + str(rng.randrange(n // 4)) + rng.choice([" ", "\n"]) + "end" if kind < 0.8 else f"own {i}"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [TEXTS, copies(1, 600), [(i, "one") for i in range(300)], []], ids=["edge cases", "groups", "one group", "empty"])
def test_exact_duplicates(spark, rows):
    got = exact_dedup.mark_duplicates(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({normalised(t) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_cut_by_many_ranges(spark, monkeypatch):
    """With more ranges than rows of the large group, it is spread over many of them."""
    monkeypatch.setattr(exact_dedup, "RANGES_PER_PARTITION", 40)
    rows = copies(2, 500)
    got = exact_dedup.mark_duplicates(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)


def test_dropping_keeps_all_columns(spark):
    df = table(spark)
    out = exact_dedup.drop_duplicates(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(normalised(r["text"]) for r in out.collect()) == sorted({normalised(t) for _, t in TEXTS})


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.mark_duplicates(table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|SinglePartition", plan)


def near_rows(seed, groups=25, width=40):
    """Groups of near copies at all distances around the limit, chains of them, and a passage that all share."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(12)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(3, width))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy).title()))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_match_brute_force(spark, width):
    rows = near_rows(width) + [(10_000 + i, t) for i, t in TEXTS if i is not None and i != 13] + [(20_000, "One two THREE")]
    got = {r["doc_id"]: r for r in near_dedup.near_groups(table(spark, rows), width=width).collect()}
    want = near_components(rows, width)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingle_set(dict(rows)[i], width)) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_a_large_group_hides_nobody(spark):
    """Many near copies of one text, and two further texts near each other that share part of it."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    other = base[:95] + [f"y{i}" for i in range(40)]
    rows += [(1000, " ".join(other)), (1001, " ".join(other[:-1] + ["z"]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(table(spark, rows), neighbours=2).collect()}
    assert got == near_components(rows, 5)


def test_a_task_inside_one_group_hands_on_few_rows():
    n = 30_000
    columns = [pa.array([0] * n, pa.int32()), pa.array([b"\0" * 24] * n, pa.binary()), *[pa.array(x, pa.int64()) for x in (range(n), [100] * n, [0] * n)]]
    batch = pa.RecordBatch.from_arrays(columns, ["tree", "key", "id", "n", "comp"])
    for edges, most in ((True, 2 * near_dedup.NEIGHBOURS + 1), (False, 0)):
        out = list(near_dedup._pairs(iter([batch]), near_dedup.NEIGHBOURS, 80, edges))
        assert sum(b.num_rows for b in out) <= most


def test_links_with_any_member_of_a_chain(spark, monkeypatch):
    """Chains of versions, and a document near each version: in one order alone, all links inside its regions are found."""
    monkeypatch.setattr(near_dedup, "TREES", 1)
    rng, rows = random.Random(6), []
    for c in range(25):
        at = 0
        for v in range(8):
            version = [f"c{c}_{i}" for i in range(at, at + 84)]
            near = version[:20] + [f"x{c}_{v}_{i}" for i in range(4)] + version[24:]
            rows += [(len(rows), " ".join(version)), (len(rows) + 1, " ".join(near))]
            at += rng.randrange(2, 8)
    rng.shuffle(rows)
    df = table(spark, rows)
    region = {r["id"]: bytes(r["signature"])[:4 * near_dedup.BASE] for r in near_dedup.sketches(df, "doc_id", "text", 5).collect()}
    want = {}
    for key in set(region.values()):
        want |= near_components([r for r in rows if region[r[0]] == key], 5)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()}
    every = near_components(rows, 5)
    assert all(got[i] == got[want[i]] and every[i] == every[got[i]] for i in got)


def test_mates_among_thousands_around_one_passage(spark):
    """Documents of one passage of 80 shingles with 15 further ones each: pairs of mates share five of these (similarity 85 / 105), others none
    (80 / 110)."""
    passage = [f"p{i}" for i in range(84)]
    rows = [(2 * i + j, " ".join(passage + [f"m{i}_{k}" for k in range(5)] + [f"o{i}_{j}_{k}" for k in range(10)])) for i in range(1200) for j in (0, 1)]
    rows += [(2 * i + j, " ".join(passage + [f"o{i}_{j}_{k}" for k in range(15)])) for i in range(1200, 1500) for j in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 if i < 2400 else i for i, _ in rows}


def test_near_groups_edge_cases(spark):
    got = near_dedup.near_groups(table(spark)).collect()
    assert len(got) == len(TEXTS)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[2][0]["component_id"] == 1 and not by_id[2][0]["kept"]
    assert all(by_id[i][0]["kept"] and by_id[i][0]["n_shingles"] == 0 for i in (4, 5, 6))
    assert [r["component_id"] for r in by_id[13]] == [12, 12]
    assert all(r["component_id"] is None and r["kept"] for r in by_id[None])
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1001)], "a bigint, b bigint").repartition(6)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 400)}, 1001: 1000}


def test_word_hashes_follow_words():
    rows = [(t or "").encode() for _, t in TEXTS]
    h, first = hashing.words(rows)
    from tests.llm.helpers import words
    names = {}
    for k, (_, t) in enumerate(TEXTS):
        w = words(t)
        assert first[k + 1] - first[k] == len(w)
        for name, value in zip(w, h[first[k]:first[k + 1]].tolist()):
            assert names.setdefault(name, value) == value
    assert len(set(names.values())) == len(names)


def thue_morse():
    """A word of a and b, and the one with both exchanged: every polynomial over 64-bit integers gives them one hash."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_stay_apart(spark):
    one, two = thue_morse()
    h, _ = hashing.words([f"{one} {two} {'a' * 1024} {'b' * 1024} {one[:-1]} {one}".encode()])
    assert len(set(h.tolist())) == 5 and h[0] == h[-1]
    got = near_dedup.near_groups(table(spark, [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}")])).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (i, True) for i in (1, 2, 3, 4)}


def test_passages_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2900, 400))
    ends = np.maximum.accumulate(starts + rng.integers(0, 40, 400))
    values = hashing.passages(data, starts, ends)
    by_bytes = {}
    for s, e, v in zip(starts, ends, values.tolist()):
        assert by_bytes.setdefault(data[s:e].tobytes(), v) == v
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_chunks_cover_the_text_and_survive_shifts():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij é") for _ in range(20_000))
    data = np.frombuffer(text.encode(), np.uint8)
    ends = fingerprints.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= fingerprints.LARGEST and sizes[:-1].min() >= fingerprints.SMALLEST
    whole = fingerprints.chunk_set(text)
    assert fingerprints.likeness(whole, fingerprints.chunk_set("a few characters more " + text)) > 0.95
    assert fingerprints.read(fingerprints.written(whole)) == whole
    assert fingerprints.likeness(whole, whole) == 1 and fingerprints.likeness({}, {}) == 1 and fingerprints.likeness(whole, {}) == 0


def test_blocks_do_not_move_boundaries(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 110, 5000).astype(np.uint8)
    want = fingerprints.cuts(data)
    monkeypatch.setattr(fingerprints, "_BLOCK", 701)
    assert fingerprints.cuts(data) == want


def test_edited_texts_follow_descending_ids(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 13] + [(100 + i, f"text {i} " * (i % 7)) for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edited(table(spark, rows).repartition(4)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        new = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        sets = [fingerprints.chunk_set(x) for x in (t, new, following)]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.written(sets[0]) and r["edited_fingerprint"] == fingerprints.written(sets[1])
        assert r["near_edited"] == fingerprints.likeness(sets[0], sets[1]) and r["near_next"] == fingerprints.likeness(sets[0], sets[2])


def test_fingerprint_edge_cases(spark):
    assert fingerprints.compare_with_edited(table(spark)).count() == len(TEXTS)
    assert fingerprints.compare_with_edited(table(spark, [])).count() == 0
    one = fingerprints.compare_with_edited(table(spark, [(7, "alone")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == sha256(b"aloal").hexdigest()
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(table(spark)).where(F.col("doc_id").isNotNull()).collect()}
    assert prints[4] == prints[5] == "" and prints[12] != prints[13]
