"""Language identification, personal data and language-model scores against brute force."""

import collections
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import language_id, pii, suffix_tree
from shelfwise.llm.queries import QUERIES
from tests.llm.helpers import TEXTS, table, words

SF = "/root/testdata/sf0.001"
KINDS = pii.KINDS
# The base patterns as given.
BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p) < 4000 and int(p) <= 255 for p in match.split("."))
    if kind == 3:
        return 9 <= len(digits) <= 15
    total = sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(BASE[k], text or "") if passes(k, m.group()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def joined(df, *columns):
    return [[r[c] for c in columns] for r in df.select(*[pii.span_text(F.col(c)).alias(c) if c.endswith("spans") else F.col(c) for c in columns]).collect()]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "0300.1.1.001", "256.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-9999", "+49.30.1234567", "+1", " ", ", ", "é", "\n", "😀", "-", "12", "007"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(500)] + [(1000 + i, t) for i, t in TEXTS if i is not None]
    found = pii.find(table(spark, rows), carry=["text"])
    assert not re.search("Python|Pandas|Arrow|Exchange", found._jdf.queryExecution().toString())
    got = joined(found, "doc_id", "text", "base_spans", "spans", "n_email", "n_ip", "n_card", "n_phone")
    assert len(got) == len(rows)
    for _, text, base, spans, *counts in got:
        assert base == base_spans(text)
        assert counts == [base.count(k + ":") for k in KINDS]
        assert set(filter(None, base.split(","))) <= set(spans.split(","))


def test_added_spans_are_disjoint_and_sensible(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.find(docs, carry=["text"]).where(F.size("spans") > F.size("base_spans")).collect()
    assert got
    for r in got:
        for x in [x for x in r["spans"] if x not in r["base_spans"]]:
            assert passes(x["k"], r["text"][x["s"]:x["e"]])
            assert all(y == x or y["e"] <= x["s"] or x["e"] <= y["s"] for y in r["spans"])


def test_proposals_of_all_rows_are_counted(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 40, raising=False)  # no bound on rows may come between
    seen = []
    monkeypatch.setattr(pii, "_fit", lambda settled, fit=pii._fit: seen.append(settled) or fit(settled))
    texts = ["mail a.b@example.org now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112"]
    pii.find(table(spark, [(i, texts[i % 2]) for i in range(400)]))
    (counted,) = seen
    assert counted.agg(F.sum("n" if "n" in counted.columns else F.lit(1))).first()[0] >= 400 and counted.count() < 100


def test_trees_decide_addresses_and_numbers_in_dropped_matches(spark):
    """Spelled addresses have features of their own and are added, words between full stops are not; cards in pairs of digits and numbers
    that the base rules drop with their neighbours are found whole."""
    planted = [("write to jane.doe(at)mail.example.org today", "email:9:37"), ("mail bob [at] example [dot] com now", "email:5:31"), ("meet me (at) noon. Then we go", ""),
               ("n" * 80 + " (at) firm.de", f"email:0:{80 + 13}"), ("4111 1111 1111 1111 5500 0000 0000 0004", "card:0:19,card:20:39"),
               ("call +49 30 1234567 10.0.0.1", "phone:5:19,ip:20:28"), ("41 11 11 11 11 11 11 11 ok", "card:0:23")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = spark.createDataFrame([(-1 - i, t) for i, (t, _) in enumerate(planted)], "doc_id bigint, text string")
    got = pii.find(docs.union(rows)).where("doc_id < 0").select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {-1 - i: want for i, (_, want) in enumerate(planted)}


def test_redaction(spark):
    df = table(spark)
    out = pii.redact(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[8] == "call <PHONE> or <EMAIL>, card <CARD>, ip <IP>!"
    assert texts[4] is None and texts[5] == "" and texts[10] == "x" * 30_000
    assert pii.redact(table(spark, [])).count() == 0


def test_running_sums_over_blocks(spark):
    n = [0, 1, 255, 256, 257, 3000]
    df = spark.createDataFrame([(list(range(k)),) for k in n], "x array<int>").select(pii._running(F.col("x")).alias("s"))
    assert sorted((r["s"] for r in df.collect()), key=len) == [np.cumsum(range(k)).tolist() for k in n]


def brute_language(model, rows):
    """The fused posterior, from the definitions, for (id, text, declared, host, suffix) rows."""
    k, texts = len(model.languages), {}
    posterior = lambda s: np.exp(np.array(s) - max(s)) / np.exp(np.array(s) - max(s)).sum()
    scored = [(r, model.scores(r[1] or "")) for r in rows]
    known = [(r, posterior(s)) for r, s in scored if s is not None]
    total = sum(p for _, p in known)
    whole = (total / len(known) + 1e-6) / (total / len(known) + 1e-6).sum()

    def mix(pick, up):
        own = [p for r, p in known if pick(r)]
        return (sum(own, np.zeros(k)) + language_id.STRENGTH * up) / (len(own) + language_id.STRENGTH)

    for r, s in scored:
        if s is None:
            texts[r[0]] = (None, 0.0)
            continue
        host = mix(lambda x: x[3:] == r[3:], mix(lambda x: x[4] == r[4], whole))
        said = (sum((p for x, p in known if x[2] == r[2]), np.zeros(k)) + whole) / (np.maximum(total, 1e-6) + language_id.STRENGTH)
        p = posterior(np.array(s) + np.log(host) + np.log(said))
        texts[r[0]] = (model.languages[int(p.argmax())] if p.max() >= language_id.CONFIDENT else None, p.max())
    return texts


def test_language_evidence_is_fused(spark):
    labelled = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 3, "text string, lang string")
    model = language_id.fit(labelled, "text", "lang")
    rows = [(1, "the dog", "en", "a.co.uk", "uk"), (2, "xq", "de", "b.de", "de"), (3, "und die", "de", "b.de", "de"), (4, None, "fr", "c.fr", "fr"), (5, "12 34 !!", "", "", ""),
            (6, "le chat", "fr", "c.fr", "fr"), (7, "zz", "", "c.fr", "fr"), (8, "die Katze und", "de", "d.de", "de")] + [(10 + i, "der Hund und die", "de", "b.de", "de") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, said string, host string, suffix string, id int, scores string")
    got = {r["doc_id"]: r for r in language_id.identify(df, model, "doc_id", "text", "said", "host", "suffix").collect()}
    want = brute_language(model, rows)
    assert {i: r["language"] for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i]["probability"] - want[i][1]) < 1e-6 for i in got)
    assert got[2]["language"] == "de" and not got[4]["accepted"] and not got[5]["accepted"]
    clashing = df.toDF("doc_id", "_text", "language", "accepted", "probability", "c0", "text").withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id")))
    kept = language_id.accepted(clashing, model, "_text", "language", "accepted", "probability")
    assert kept.schema == clashing.schema
    accepted = {i for i, r in got.items() if r["accepted"]}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in clashing.collect() if (r["doc_id"] or 2) in accepted)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), "text", "lang")
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in got) >= 0.98 * len(got)


def test_rare_languages_have_a_class(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 50)
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(3000)] + [(5000 + i, f"le chat et le chien {i}", "fr") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df, "text", "lang")
    assert model.languages == ["en", "fr"]
    got = language_id.identify(df.where("lang = 'fr'"), model, "doc_id", "text").collect()
    assert [r["language"] for r in got] == ["fr"] * 6


def test_pages_by_markup_and_address(spark):
    """The registered query over all pages: every page has a row, and languages are those of its markup."""
    got = QUERIES["op2_language_id"](spark, SF).collect()
    said = {r["page_id"]: r["said"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", language_id.declared_in(F.col("html")).alias("said")).collect()}
    assert sorted(r["page_id"] for r in got) == sorted(said) and sum(r["language"] == said[r["page_id"]] for r in got) >= 0.9 * len(got)


def test_each_evidence_changes_results(spark):
    """One text that fits two languages equally, told apart by markup, by suffix, or by host alone."""
    labelled = spark.createDataFrame([("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 3, "text string, lang string")
    model = language_id.fit(labelled, "text", "lang")
    german, french = "der Hund und die Katze", "le chat et le chien"
    rows = [(f"http://a{i}.{s}/x", f'<html lang="{w}"><p>{t}', "") for i in range(20) for s, w, t in (("de", "de", german), ("fr", "fr", french), ("com", "", german), ("com", "", french))]
    rows += [(f"https://u@{h}.com:80/{i}", t, "") for i in range(20) for h, t in (("g", german), ("f", french))]
    for url, html in (("http://new.org/", "<html id=1 LANG='{}-x'>zzz"), ("http://new.{}/", "<script>der Hund</script>zzz"), ("http://{}.com/", "zzz&amp;")):
        for word in ("de", "fr"):
            host = {"de": "g", "fr": "f"}[word] if url == "http://{}.com/" else word
            rows.append((url.format(host), html.format(host), word))
    host = language_id.host_of(F.col("url"))
    pages = spark.createDataFrame(rows, "url string, html string, want string").select("want", language_id.text_of(F.col("html")).alias("text"), language_id.declared_in(F.col("html")).alias("said"),
                                                                                      host.alias("host"), language_id.suffix_of(host).alias("suffix"))
    assert {(r["want"], r["language"]) for r in language_id.identify(pages, model, "want", "text", "said", "host", "suffix").collect() if r["want"]} == {("de", "de"), ("fr", "fr")}
    for blind in ({"declared_column": None}, {"suffix_column": None, "host_column": None}, {"host_column": None}):
        columns = {"declared_column": "said", "host_column": "host", "suffix_column": "suffix"} | blind
        got = [(r["want"], r["language"]) for r in language_id.identify(pages, model, "want", "text", **columns).collect() if r["want"]]
        assert any(want != language for want, language in got), blind


def test_language_edge_cases(spark):
    empty = language_id.fit(table(spark, []), "text", "lang")
    assert [r["accepted"] for r in language_id.identify(table(spark), empty, "doc_id", "text").collect()] == [False] * len(TEXTS)
    model = language_id.fit(table(spark), "text", "lang")
    got = language_id.identify(table(spark), model, "doc_id", "text", "lang", "source").collect()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in TEXTS if i is not None}
    assert len(got) == len(TEXTS) and all(r["accepted"] == letters[r["doc_id"]] for r in got if r["doc_id"] not in (8, None))
    assert language_id.identify(table(spark, []), model, "doc_id", "text").count() == 0


def brute_base(rows):
    tokens = [(i, words(t) + ["\n"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens), key=str)


@pytest.mark.parametrize("rows", [TEXTS, [(6, "held out alone")], []], ids=["edge cases", "no training", "empty"])
def test_base_scores(spark, rows):
    got = suffix_tree.score(table(spark, rows)).collect()
    got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    want = brute_base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5])) for g, w in zip(got, want))


def test_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, f"a b {'c' * (i % 5)} a") for i in range(200)]
    want = sorted((r["doc_id"], round(r["base_score"], 9), round(r["score"], 9), r["n_known"]) for r in suffix_tree.score(table(spark, rows)).collect())
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.2)
    assert sorted((r["doc_id"], round(r["base_score"], 9), round(r["score"], 9), r["n_known"]) for r in suffix_tree.score(table(spark, rows)).collect()) == want


def test_tree_is_a_distribution_and_uses_the_longest_context(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SHARE", 1e-3)
    monkeypatch.setattr(suffix_tree, "GAIN", 2.0)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["thea", "theb", "xyz", "then"]) for _ in range(30))) for i in range(60)]
    counts = suffix_tree.count(table(spark, rows).select(F.col("doc_id").alias("id"), "text")).cache()
    tree = suffix_tree.grow(counts.where("kind = 1").select("key", "n"))
    assert sum(map(len, tree.contexts)) > 3
    every = np.arange(256, dtype=np.uint64)
    for context in (b"\0\0\0\0\n", b" thea", b"a the", b"zz th", b"qqqqq"):
        state = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        assert abs((10 ** tree.fresh(state | every)).sum() - 1) < 1e-9
    table_counts = {r["key"]: r["n"] for r in counts.where("kind = 1").collect()}
    by = lambda suffix: {x: sum(n for k, n in table_counts.items() if (k >> 8) & ((1 << 8 * len(suffix)) - 1) == int.from_bytes(suffix, "big") and k & 255 == x) for x in range(256)}

    def brute(context, x):
        kept = [len(context) - s for s in range(len(context)) if (int.from_bytes(context[s:], "big")) in set(tree.contexts[len(context) - s - 1].tolist())]
        p = (by(b"")[x] + 0.5) / (sum(by(b"").values()) + 128)
        for length in range(1, max(kept, default=0) + 1):
            n = by(context[-length:])
            kinds = sum(v > 0 for v in n.values())
            p = (n[x] + kinds * p) / (sum(n.values()) + kinds)
        return p

    for context, x in ((b"n the", ord("a")), (b"z the", ord("q")), (b"xyz t", ord("h"))):
        g = np.array([(int.from_bytes(context, "big") << 8) | x], np.uint64)
        assert abs(10 ** tree.scores(g)[0] - brute(context, x)) < 1e-9 and tree.scores(g)[0] == tree.scores(g)[0]


def test_scores_beat_the_base_on_held_out_texts(spark):
    got = suffix_tree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
