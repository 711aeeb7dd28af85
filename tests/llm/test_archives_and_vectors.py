"""Alignment, web archives and whitening against brute force."""

import base64
import gzip
import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import alignment, warc, whitening
from shelfwise.llm.wordbpe import _byte_symbols
from tests.llm.helpers import TEXTS, table

HARD = TEXTS + [(20, "▁ underscore piece"), (21, "<|endoftext|> <s> </s> <unk> <0x41>"), (22, " leading"), (23, "a" * 3000 + " b"), (24, " " * 25_000 + "x"), (25, "日本 \x00  é é"), (26, "the end")]


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(_byte_symbols())}
    out, links = [], []
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends = [list(np.cumsum([len(x) for x in side])) for side in (bytes_a, bytes_b)]
        groups, ia, ib = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            ja, jb = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((ids_a[ia:ja], ids_b[ib:jb]))
            ia, ib = ja, jb
        links.append([(x[-1], y[-1]) for x, y in groups])
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([doc, len(ids_a), len(ids_b), len(groups), len(groups), hashlib.sha256(shown.encode()).hexdigest() if groups else ""])
    n, most = Counter(p for row in links for p in row), defaultdict(int)
    for (x, y), k in n.items():
        most[y] = max(most[y], k)
    return [(r[0], *r[1:5], sum(n[p] == most[p[1]] for p in row), sum(n[p] for p in row), r[5]) for r, row in zip(out, links)]


@pytest.mark.parametrize("rows", [HARD, [(1, None), (2, "")], []], ids=["edge cases", "no tokens", "empty"])
def test_alignment(spark, rows):
    got = alignment.digests(table(spark, rows)).collect()
    assert sorted(map(str, brute_alignment(rows))) == sorted(str(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got)


def test_alignment_ranges(spark):
    """The general form: cuts and overlap ranges, by comparing all tokens' bytes."""
    v = alignment.vocabularies()
    for r in alignment.align(table(spark, [x for x in HARD if len(x[1] or "") < 4000])).collect():
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for ids, side in ((r["a_ids"], v.a_bytes), (r["b_ids"], v.b_bytes))]
        assert [ends[0][i] for i in r["a_cuts"]] == [ends[1][i] for i in r["b_cuts"]] == sorted(set(ends[0]) & set(ends[1]))
        mine, other = ends if r["driver"] == "a" else ends[::-1]
        for i, (s, e) in enumerate(zip([0] + mine, mine)):
            met = [j for j, (t, f) in enumerate(zip([0] + other, other)) if t < e and f > s]
            assert (r["overlap_from"][i], r["overlap_to"][i]) == (met[0], met[-1])


def test_galloping_search():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (50, 1000), (400, 410)):
        short, long = np.unique(rng.integers(0, 3 * max(n, m, 1), n)), np.unique(rng.integers(0, 3 * max(n, m, 1), m))
        for start in (np.zeros(len(short), np.int64), rng.integers(-3, m + 3, len(short))):
            assert (alignment.gallop(short, long, start) == np.searchsorted(long, short)).all()


PAGES = [(5, "http://a/x y", "same"), (3, None, "same"), (9, "", "same"), (4, "http://b/é\r\nX: y", None), (2, "u", ""), (7, "u", "ünï" * 5000), (None, "u", "same"), (None, "v", "own"), (None, "v", "own"),
         (11, "u", "own twice"), (11, "u", "own twice"), (11, "u", "other"), (12, "u", "WARC/1.1\r\n\r\n\r\n\r\nHTTP"), (13, "u", "x" * 70_000), (14, "u", "x" * 70_000), (-1, "u", "neg"), (0, "u", "neg")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "k", b"d") for r in rows], "page_id bigint, url string, html string, id int, sha1 string, data binary")


def brute_archive(rows, least=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        stays = min(ids) if ids and len(raw) >= least else page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == stays else "revisit", None if page == stays else stays))
    return out


@pytest.mark.parametrize("rows", [PAGES, [(i, "u", "one") for i in range(300)], []], ids=["edge cases", "one payload", "empty"])
@pytest.mark.parametrize("options", [{}, {"compress": False, "chunk": 1000, "file_bytes": 3000, "segment_bytes": 700}, {"chunk": 7, "revisit_bytes": 5, "segment_bytes": 1}], ids=["whole", "small files", "small chunks"])
def test_archives(spark, tmp_path, rows, options):
    manifest = warc.write(pages(spark, rows), str(tmp_path), **options)
    got = warc.records(manifest, chunk=options.get("chunk", warc.CHUNK)).collect()
    assert sorted(map(str, brute_archive(rows, options.get("revisit_bytes", 0)))) == sorted(str(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got)
    assert manifest.agg(F.sum("records")).first()[0] == (len(rows) or None)


def test_archive_chunks_and_format(spark, tmp_path):
    manifest = warc.write(pages(spark), str(tmp_path), chunk=1000)
    rows = warc.read(manifest, chunk=1000).orderBy("record_id", "chunk_no").where("record_type = 'response'").collect()
    whole = defaultdict(bytes)
    for r in rows:
        assert len(r["data"]) <= 1000
        whole[r["record_id"]] += r["data"]
        if not r["record_id"].endswith((":11", ":null")):  # repeated ids
            assert r["digest"] == base64.b32encode(hashlib.sha1(whole[r["record_id"]]).digest()).decode()
    assert whole["urn:x-page:7"].decode() == "ünï" * 5000 and whole["urn:x-page:13"] == b"x" * 70_000
    for r in manifest.collect():
        with open(r["path"], "rb") as f:
            text = gzip.decompress(f.read())
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nX: y" not in text


def test_damaged_archives_are_refused(spark, tmp_path):
    manifest = warc.write(pages(spark, [(1, "u", "payload one"), (2, "u", "payload two")]), str(tmp_path), compress=False)
    for path in {r["path"] for r in manifest.collect()}:
        with open(path, "rb") as f:
            raw = f.read()
        with open(path, "wb") as f:
            f.write(raw.replace(b"payload two", b"payload twO"))
    with pytest.raises(Exception, match="is not the one its header tells"):
        warc.records(manifest).collect()


def test_a_common_payload_is_split(spark):
    """Rows of one payload and the group they belong to are joined by staged tables, which Spark can split."""
    plan = warc._plan(pages(spark).selectExpr("page_id AS id", "url", "cast(html AS binary) AS payload"), 1000, 0)
    text = plan._jdf.queryExecution().toString()
    assert "Window" not in text and "CartesianProduct" not in text


NAN = float("nan")
VECTORS = [(1, [0.5, -1.0, 2.0]), (2, [0.25, 3.0, -2.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [NAN, 1.0, 2.0]), (7, [math.inf, 0.0, 0.0]), (8, [1.0, 2.0]), (9, [0.5, -1.0, 2.0]), (9, [0.5, -1.0, 2.0]),
           (None, [-4.0, 0.125, 7.5]), (10, [1e3, 0.0, 1.0]), (11, [0.1, 0.2, 0.3])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, [3.0]) for i, v in rows], "vec_id bigint, embedding array<float>, id int, n int, vector array<double>")


def quantise(rows, size):
    kept = [(i, v) for i, v in rows if v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    return kept, [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]


def check_whitening(rows, size, got, k):
    kept, x = quantise(rows, size)
    n = len(x)
    s = [sum(c) for c in zip(*x)]
    z = [[n * c - t for c, t in zip(row, s)] for row in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n ** 3)) for j in range(size)] for i in range(size)])
    values = np.linalg.eigvalsh(v)[::-1]
    assert Counter((r["vec_id"], r["deviation"], r["component"]) for r in got) == Counter((i, sum(c * c for c in row), a + 1) for (i, _), row in zip(kept, z) for a in range(k))
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-6 and len({r["identity_error"] for r in got}) == 1
    for r in got:
        e = values[r["component"] - 1]
        assert r["explained"] == pytest.approx(e / np.trace(v), rel=1e-4)
    # the squared scores over all components are the Mahalanobis distances, whatever the signs
    if k == size:
        far = Counter()
        for r in got:
            far[r["vec_id"], r["deviation"]] += r["whitened"] ** 2
        times = Counter((i, sum(c * c for c in row)) for (i, _), row in zip(kept, z))
        for (i, _), row in zip(kept, z):
            y = np.array(row, float) / n
            key = (i, sum(c * c for c in row))
            assert far[key] / times[key] == pytest.approx(y @ np.linalg.solve(v, y), rel=1e-6)


def test_whitening(spark):
    check_whitening(VECTORS, 3, whitening.whiten(vectors(spark, VECTORS)).collect(), 3)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))).tolist())]
    check_whitening(rows, 6, whitening.whiten(vectors(spark, rows)).collect(), 6)
    check_whitening(rows, 6, whitening.whiten(vectors(spark, rows), components=2).collect(), 2)


def test_whitening_without_directions(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in got] == [False, True] * 2 and got[0]["identity_error"] < 1e-12 and got[0]["explained"] == 1.0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, 0.0, 0.0)] * 2
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in huge)


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for d, n, top in ((5, 100, 9), (3, 1000, 1 << 20), (4, 77, 1 << 40), (2, 9, 1 << 62), (2, 3, 1), (1, 65, 2)):
        y = rng.integers(0, top, (n, d))
        assert (whitening.cross_products(y) == y.astype(object).T @ y.astype(object)).all()
