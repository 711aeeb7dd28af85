"""Temporal and leave-one-out protocols, and the operators that keep them linear, against brute force."""

import dataclasses
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import history, loo, prefixes, ranks, scan, temporal
from shelfwise.operators.running import totals_before, vector_totals_before
from shelfwise.operators.skew import salted_join
from shelfwise.params import FeatureParams

EVENTS = "event_id bigint, user_id bigint, product_id bigint, action_type string, action_time timestamp_ntz"
D0 = datetime(2024, 1, 1)


def day(x):
    return D0 + timedelta(days=x)


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENTS)


def scenario(spark):
    rows = [(1, 10 + i, "PURCHASE", day(d)) for i, d in enumerate((1, 5, 10, 20))] + [(2, 20, "PURCHASE", day(2)), (2, 21, "PURCHASE", day(8)), (3, 30, "PURCHASE", day(3)), (4, 40, "CLICK", day(1))]
    return log(spark, rows), spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 5)], "user_id bigint")


def test_split_tiers_and_targets(spark):
    events, users = scenario(spark)
    s = temporal.splits(events, users)
    got = {r.user_id: (r.tier, r.val_cutoff, r.test_cutoff, r.train_purchases) for r in s.collect()}
    assert got == {1: ("FULL", day(10), day(20), 2), 2: ("VAL_ONLY", day(8), None, 1), 3: ("INSUFFICIENT_DEPTH", None, None, 1),
                   4: ("ENGAGEMENT_NO_PURCHASE", None, None, 0), 5: ("NO_HISTORY", None, None, 0)}
    targets = {(r.user_id, r.split, r.product_id) for r in temporal.targets(events, s).collect()}
    assert targets == {(1, "val", 12), (1, "test", 13), (2, "val", 21)}


def test_tied_last_purchases(spark):
    events = log(spark, [(1, 1, "PURCHASE", day(1)), (1, 2, "PURCHASE", day(3)), (1, 3, "PURCHASE", day(3)), (2, 7, "PURCHASE", day(2)), (2, 8, "PURCHASE", day(2))])
    s = temporal.splits(events, spark.createDataFrame([(1,), (2,)], "user_id bigint"))
    got = {r.user_id: (r.tier, r.val_cutoff, r.test_cutoff, r.train_purchases) for r in s.collect()}
    assert got == {1: ("FULL", day(3), day(3), 1), 2: ("VAL_ONLY", day(2), None, 0)}
    targets = {(r.user_id, r.split, r.product_id) for r in temporal.targets(events, s).collect()}
    assert targets == {(1, "test", 2), (1, "test", 3), (2, "val", 7), (2, "val", 8)}


def test_target_window_bounds(spark):
    events = log(spark, [(1, 10, "PURCHASE", day(2)), (1, 11, "PURCHASE", day(3)), (1, 12, "PURCHASE", day(2.5)), (1, 13, "CLICK", day(2.2))])
    w = spark.createDataFrame([(1, day(2), day(3))], "user_id bigint, lower timestamp_ntz, upper timestamp_ntz")
    assert {r.product_id for r in temporal.window_targets(events, w).collect()} == {10, 12}


def test_history_is_strictly_before_the_cutoff(spark):
    events = log(spark, [(1, 1, "CLICK", day(1)), (1, 2, "CLICK", day(2)), (1, 3, "CLICK", None), (1, 4, "CHATBOT", day(3))])
    cases = spark.createDataFrame([(7, 1, day(2))], "example_id bigint, user_id bigint, cutoff timestamp_ntz")
    from shelfwise.params import Recency
    assert [r.product_id for r in history.case_history(history.signals(events), cases, Recency()).collect()] == [1]


def test_audit_finds_injected_rows_but_not_repeat_purchases(spark):
    points = spark.createDataFrame([(1, "val", day(5))], "user_id bigint, split string, cutoff timestamp_ntz")
    target = spark.createDataFrame([(1, "val", 9)], "user_id bigint, split string, product_id bigint")
    rows = log(spark, [(1, 9, "PURCHASE", day(1)), (1, 9, "PURCHASE", day(5)), (1, 3, "CLICK", day(6)), (1, 4, "CLICK", None)]).withColumn("split", F.lit("val"))
    r = temporal.audit(rows, points, target).first()
    assert (r.violations, r.without_time, r.on_targets) == (3, 1, 1)
    assert any("[TARGET PRODUCT]" in m.violation for m in temporal.audit_messages(rows, points, target).collect())
    assert temporal.audit(rows.where("product_id = 9 AND action_time < TIMESTAMP_NTZ'2024-01-03'"), points, target).first().violations == 0


def test_salted_join_equals_plain_join_under_skew(spark):
    facts = spark.createDataFrame([(i, 1 if i % 3 else i % 50) for i in range(3000)], "id bigint, k bigint").withColumn("v", F.col("id") % 7)
    facts = facts.unionByName(spark.createDataFrame([(9999, None, 1)], "id bigint, k bigint, v bigint"))
    dims = spark.createDataFrame([(k, lim) for k in range(40) for lim in (2, 5)], "k bigint, lim bigint")
    plain = facts.join(dims, "k").where("v < lim").select("id", "lim")
    salted = salted_join(facts, dims, ["k"], condition=F.col("v") < F.col("lim"), hot_rows=100, spread=["id"]).select("id", "lim")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    left = salted_join(facts, dims, ["k"], how="left", hot_rows=100, spread=["id"])
    assert left.count() == facts.join(dims, "k", "left").count()


def test_totals_before_equals_brute_force(spark):
    rng = random.Random(3)
    ev = [(rng.choice([1, 1, 1, 2]), rng.choice("ab"), day(rng.randrange(0, 400) / 40), float(rng.randrange(1, 9)), rng.randrange(100)) for _ in range(300)]
    pr = [(i, rng.choice([1, 2, 3]), rng.choice("ab"), day(rng.randrange(0, 400) / 40)) for i in range(80)]
    events = spark.createDataFrame(ev, "u bigint, s string, ts timestamp_ntz, x double, m bigint")
    probes = spark.createDataFrame(pr, "probe_id bigint, u bigint, s string, ts timestamp_ntz")
    got = {r.probe_id: (r.x, r.m) for r in totals_before(events, probes, ["u", "s"], ["x"], ["m"], cell_seconds=7200).collect()}
    for i, u, s, ts in pr:
        past = [e for e in ev if e[0] == u and e[1] == s and e[2] < ts]
        assert got[i] == (sum(e[3] for e in past), max((e[4] for e in past), default=None))


def test_vector_totals_before_equal_brute_force(spark):
    rng = random.Random(4)
    ev = [(rng.choice([1, 1, 1, 2]), rng.choice("ab"), day(rng.randrange(0, 400) / 40), float(rng.randrange(1, 9)), [float(rng.randrange(9)) for _ in range(3)]) for _ in range(300)]
    pr = [(i, rng.choice([1, 2, 3]), rng.choice("ab"), day(rng.randrange(0, 400) / 40)) for i in range(80)]
    events = spark.createDataFrame(ev, "u bigint, s string, ts timestamp_ntz, x double, v array<double>")
    probes = spark.createDataFrame(pr, "probe_id bigint, u bigint, s string, ts timestamp_ntz")
    got = {r.probe_id: (r.x, list(r.v)) for r in vector_totals_before(events, probes, ["u", "s"], ["x"], "v", 3, cell_seconds=7200).collect()}
    for i, u, s, ts in pr:
        past = [e for e in ev if e[0] == u and e[1] == s and e[2] < ts]
        assert got[i] == (sum(e[3] for e in past), [sum(e[4][k] for e in past) for k in range(3)])


def test_groups_that_span_batches():
    import pyarrow as pa
    from shelfwise.operators.running import _sums_before
    rows = [("a", 0, None, 1.0, [1.0]), ("a", 0, 7, None, None), ("a", 0, None, 2.0, [5.0]), ("a", 0, 8, None, None), ("a", 1, None, 4.0, [1.0]), ("b", 1, 9, None, None)]
    names, kinds = ["k", "cell", "probe_id", "x", "v"], [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i]], t) for i, t in enumerate(kinds)], names) for r in rows]
    got = [tuple(r.values()) for b in _sums_before(iter(batches), 2, 1, 1, False) for r in b.to_pylist()]
    assert got == [("a", 0, 7, 1.0, [1.0]), ("a", 0, 8, 3.0, [6.0]), ("a", 0, None, 3.0, [6.0]), ("a", 1, None, 4.0, [1.0]), ("b", 1, 9, 0.0, [0.0]), ("b", 1, None, 0.0, [0.0])]


def test_popularity_rank_equals_global_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "product_id bigint, g string, purchase_count bigint, cart_add_count bigint")
    want = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], -r[3], r[0])))}
    got = ranks.popularity_rank(df, []).collect()
    assert {r.product_id: r["rank"] for r in got} == want and {r.group_size for r in got} == {500}


def test_chronological_positions(spark):
    events = log(spark, [(1, 1, "CLICK", day(2)), (1, 2, "CLICK", None), (1, 3, "CLICK", day(0.5)), (1, 4, "CLICK", day(0.1))])
    assert {r.product_id: r.position for r in temporal.chronological(events).collect()} == {4: 1, 3: 2, 1: 3, 2: 4}


def test_loo_split_is_deterministic_and_guards_small_users(spark):
    pairs = spark.createDataFrame([(1, p) for p in range(6)] + [(2, 1), (2, 2)], "user_id bigint, product_id bigint")
    a, b = (sorted(map(tuple, loo.splits(pairs.repartition(n), 3, 42).collect())) for n in (1, 5))
    assert a == b
    roles = [r[2] for r in a if r[0] == 1]
    assert roles.count("test") == roles.count("val") == 1 and roles.count("train") == 4
    assert [r[2] for r in a if r[0] == 2] == ["train", "train"]


def test_text_mentions_equal_substring_search(spark):
    rng = random.Random(1)
    words = ["red ring", "Ring", "blue bolt", "bolt", "a", "Größe"]
    texts = [(u, i, " ".join(rng.choice(["the", "Red RING", "string", "blue  bolt", "bolts", "größen"]) for _ in range(4))) for i, u in enumerate([1, 1, 2, 2, 3])]
    names = [(u, 10 * u + j, w) for u in (1, 2) for j, w in enumerate(words)]
    got = {(r.user_id, r.text_id, r.product_id) for r in loo.text_mentions(spark.createDataFrame(texts, "user_id bigint, text_id bigint, text string"),
                                                                           spark.createDataFrame(names, "user_id bigint, product_id bigint, name string")).collect()}
    want = {(u, i, p) for u, i, t in texts for v, p, n in names if u == v and n.strip().lower() in t.strip().lower()}
    assert got == want and got


def test_running_totals_and_quantiles_without_one_task(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(40) / 8 if i % 9 else None, rng.randrange(5)) for i in range(400)] + [("alone", 1000, 2.5, 1), ("none", 1001, None, 1)]
    df = spark.createDataFrame(rows, "g string, id bigint, x double, v int")
    for group in ([], ["g"]):
        got = {r["id"]: (r["upto"], r["place"]) for r in scan.running_totals(scan.running_totals(df, group, [F.col("id").desc()], "v"), group, [F.col("id").desc()], out="place").collect()}
        want = {i: (sum(w for h, j, _, w in rows if j >= i and (h == g or not group)), sum(j >= i and (h == g or not group) for h, j, _, _ in rows)) for g, i, _, _ in rows}
        assert got == want
        parts = {r["g"] if group else 0: r["p"] for r in scan.quantiles(df, group, "x", [0.0, 1 / 3, 0.5, 0.95, 1.0]).collect()}
        for g in {r[0] for r in rows} - {"none"} if group else {0}:
            values = [x for h, _, x, _ in rows if x is not None and (not group or h == g)]
            assert parts[g] == pytest.approx(np.quantile(values, [0.0, 1 / 3, 0.5, 0.95, 1.0]).tolist())
        assert "none" not in parts
    assert scan.running_totals(df.limit(0), [], [F.col("id")]).count() == 0
    assert scan.quantiles(df.limit(0), [], "x", [0.5]).first()["p"] == [None] and scan.quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_no_task_holds_all_distinct_prices(spark):
    """A column of distinct values: what the largest task of the running count gets, and no window or state over all rows."""
    df = spark.range(40_000).selectExpr("id", "(id * 7919) % 40000 + 0.5 AS x")
    totals = scan.running_totals(df, [], [F.col("x")], out="n")
    sizes = [r["count"] for r in stage_ranges(totals).collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * 40_000 and totals.where("n <> x + 0.5").count() == 0
    assert scan.quantiles(df, [], "x", [0.25, 0.5]).first()["p"] == pytest.approx([10000.25, 20000.0], abs=1)
    for frame in (totals, scan.quantiles(df, [], "x", [0.5]), ranks.popularity_rank(df.selectExpr("id AS product_id", "x AS purchase_count", "1 AS cart_add_count"), [])):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "ercentile" not in text
        assert all("_range" in line for line in text.splitlines() if "Window [" in line)


def stage_ranges(totals):
    """Rows of each range of a running total."""
    return totals.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in totals.inputFiles()}).groupBy("_range").count()


def test_text_mentions_of_odd_names_and_long_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    texts = [(u, i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(12))) for u in (1, 2) for i in range(20)] + [(1, 100, None), (1, 101, ""), (2, 102, "  ")]
    names = [(u, j, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randrange(1, 4)))) for u in (1, 2) for j in range(60)] + [(1, 900, None), (1, 901, " "), (3, 902, "a")]
    long = "é" * 400_000 + "Red Ring" + "x" * 400_000 + " blue bolt-like " + " ".join(word() for _ in range(50_000))
    texts += [(9, 1, long)]
    names += [(9, 1, "red ring"), (9, 2, "blue bolt"), (9, 3, "éred"), (9, 4, "ringx"), (9, 5, "bolt blue"), (9, 6, "blue bolts"), (9, 7, "x" * 300_000), (9, 8, "x" * 500_000)]
    got = {tuple(r) for r in loo.text_mentions(spark.createDataFrame(texts, "user_id bigint, text_id bigint, text string"), spark.createDataFrame(names, "user_id bigint, product_id bigint, name string")).collect()}
    clean = lambda s: (s or "").strip(" ").lower()
    want = {(u, i, p) for u, i, t in texts for v, p, n in names if u == v and clean(n) and clean(n) in clean(t)}
    assert got == want and {p for u, _, p in got if u == 9} == {1, 2, 3, 4, 7}
    assert loo.text_mentions(spark.createDataFrame([(1, 1, "a")], "user_id bigint, text_id bigint, text string"), spark.createDataFrame([], "user_id bigint, product_id bigint, name string")).count() == 0


def test_pair_id_rejects_large_ids(spark):
    df = spark.createDataFrame([(5, 1 << 31)], "u bigint, p bigint")
    with pytest.raises(Exception, match="too large"):
        df.select(loo.pair_id(F.col("u"), F.col("p"))).collect()


@pytest.mark.parametrize("hot_events", [1_000_000, 4])
def test_prefixes_are_those_of_every_example(spark, hot_events):
    """Vectors and affinities before each cutoff, of users cut into days and of whole ones, against pairs of examples and events."""
    params, rng, kinds = FeatureParams(), random.Random(5), ("click", "purchase", "cart", "search", "chatbot")
    day0 = datetime(2024, 1, 1)
    log = [(u, k, p, day0 + timedelta(hours=h), 0.5 ** (10 - h / 24)) for u in (1, 2) for k, p, h in ((rng.choice(kinds), rng.randrange(6), rng.randrange(0, 200, 3)) for _ in range(12 * u))]
    asked = [(100 * u + i, u, day0 + timedelta(hours=h), 0.5 ** (10 - h / 24)) for u in (1, 2, 3) for i, h in enumerate(range(0, 260, 20))]
    chat = [(e, 0.25 + e / 1000) for e, u, cut, _ in asked if any(x[0] == u and x[1] == "chatbot" and x[3] < cut for x in log)]
    item = {p: [rng.uniform(-1, 1) for _ in range(3)] for p in range(5)}
    group = {p: "abc"[p % 3] for p in range(5)}
    frames = (spark.createDataFrame(log, "user_id bigint, signal string, product_id bigint, ts timestamp_ntz, g double"),
              spark.createDataFrame(asked, "example_id bigint, user_id bigint, cutoff timestamp_ntz, at double"), spark.createDataFrame(chat, "example_id bigint, chat_w double"))
    got = {r.example_id: r.vector for r in prefixes.user_vectors(*frames, spark.createDataFrame(list(item.items()), "product_id bigint, embedding array<double>"), params, 3, hot_events).collect()}
    catalog = spark.createDataFrame(list(group.items()), "product_id bigint, kind string")
    names = {(r.example_id, r.name): r.v for r in prefixes.attribute_contributions(*frames, catalog, "kind", params, hot_events=hot_events).collect()}
    best = {(r.example_id, r.name): r.v for r in prefixes.attribute_contributions(*frames, catalog, "kind", params, 1, hot_events).collect()}
    vectors, contributions, chat_w = {}, {}, dict(chat)
    for e, u, cut, at in asked:
        before, parts = [x for x in log if x[0] == u and x[3] < cut and x[2] in item], []
        for k in kinds:
            mine = [x for x in before if x[1] == k]
            w = [1.0 if k == "chatbot" else x[4] / at for x in mine]
            if mine:
                parts.append((params.weight(k) * (chat_w[e] if k == "chatbot" else sum(w) / len(w)), [sum(a * item[x[2]][i] for a, x in zip(w, mine)) / sum(w) for i in range(3)]))
            for a, x in zip(w, mine):
                key = (e, group[x[2]])
                contributions[key] = contributions.get(key, 0.0) + params.weight(k) * (chat_w[e] if k == "chatbot" else a)
        if parts:
            vectors[e] = [sum(b * v[i] for b, v in parts) / sum(b for b, _ in parts) for i in range(3)]
    assert got == {e: pytest.approx(v, rel=1e-9) for e, v in vectors.items()} and len(got) > 15
    assert names == {k: pytest.approx(v, rel=1e-9) for k, v in contributions.items()}
    assert best == {k: names[k] for k in names if names[k] == max(v for (e, _), v in names.items() if e == k[0])}


def test_vectors_of_examples_are_shuffled_once(spark):
    """Events carry the stored vector, examples none, and a user's rows meet in one exchange; no sums of 64 doubles travel."""
    params = FeatureParams()
    log = spark.createDataFrame([(1, "click", 1, datetime(2024, 1, 1), 1.0)], "user_id bigint, signal string, product_id bigint, ts timestamp_ntz, g double")
    ex = spark.createDataFrame([(5, 1, datetime(2024, 1, 2), 1.0)], "example_id bigint, user_id bigint, cutoff timestamp_ntz, at double")
    chat = spark.createDataFrame([], "example_id bigint, chat_w double")
    items = spark.createDataFrame([(1, [1.0, 2.0])], "product_id bigint, embedding array<float>")
    out = prefixes.user_vectors(log, ex, chat, items, params, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(user_id" in line for line in plan.splitlines()) == 1
    assert [list(r.vector) for r in out.collect()] == [[1.0, 2.0]]


def _left_out(spark, user_products, extra=()):
    """Frames of leave-one-out examples: every user bought the products given, saw some of them, and the first of each is held out."""
    rng = random.Random(3)
    counts = [(u, "purchase", p, 1 + rng.randrange(2)) for u, ps in user_products.items() for p in ps]
    counts += [(u, s, p, 1 + rng.randrange(3)) for u, ps in user_products.items() for p in (*ps, 900) for s in ("click", "cart", "search") if rng.random() < 0.4] + list(extra)
    held = [(u, ps[0]) for u, ps in user_products.items()]
    ex = [(u * 10_000 + p, u, p) for u, ps in user_products.items() for p in ps[1:]] + [(-u - 1, u, None) for u in user_products]
    usable = [(e, e % 3 != 0) for e, _, _ in ex]
    frame = spark.createDataFrame
    return counts, held, ex, dict(usable), (frame(counts, "user_id bigint, signal string, product_id bigint, n bigint"), frame(held, "user_id bigint, product_id bigint"),
                                            frame(ex, "example_id bigint, user_id bigint, product_id bigint"), frame(usable, "example_id bigint, chat_ok boolean"))


def test_left_out_examples_equal_brute_force(spark):
    """Affinities and vectors of leave-one-out examples, from a user's totals, against each example's own rows."""
    params = FeatureParams()
    chats = [(1, "chatbot", 900, 1), (2, "chatbot", 900, 2)]  # nobody bought it, so it is never left out
    counts, held, ex, usable, frames = _left_out(spark, {1: list(range(1, 12)), 2: [3, 4, 5], 3: [8, 9]}, chats)
    group = {p: "abcdefgh"[p % 8] for p in (*range(1, 12), 900)}
    item = {p: [float(p % 5) - 2, 1.0 / p, 0.5] for p in (*range(1, 11), 900)}  # 11 has none
    catalog = spark.createDataFrame(list(group.items()), "product_id bigint, kind string")
    bonus = {1: "h", 3: "z"}
    top = {r.example_id: {e.name: e.weight for e in r.top} for r in loo.top_attributes(
        *frames, catalog, "kind", params, 3, spark.createDataFrame([(u, n, 0.5) for u, n in bonus.items()], "user_id bigint, name string, bonus double")).collect()}
    open_texts = [(1, 51, "x"), (1, 52, "y"), (2, 53, "x")]  # 51 names product 5, 52 the held one
    texts = (spark.createDataFrame(open_texts, "user_id bigint, text_id bigint, text string"), spark.createDataFrame([(1, 51, 5), (1, 52, 1)], "user_id bigint, text_id bigint, product_id bigint"),
             spark.createDataFrame([(2, "y")], "user_id bigint, text string"), spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("y", [0.0, -1.0, 4.0])], "text string, embedding array<double>"))
    items = spark.createDataFrame(list(item.items()), "product_id bigint, embedding array<double>")
    plain = {r.example_id: r.vector for r in loo.user_vectors(*frames, items, params, 3).collect()}
    with_text = {r.example_id: r.vector for r in loo.user_vectors(*frames, items, params, 3, *texts).collect()}
    word, want_top, want_plain, want_text = {"x": [1.0, 2.0, 3.0], "y": [0.0, -1.0, 4.0]}, {}, {}, {}
    for e, u, own in ex:
        out = {p for v, p in held if v == u} | {own}
        rows = [(s, p, n) for v, s, p, n in counts if v == u and p not in out and (s != "chatbot" or usable[e])]
        sums = {bonus[u]: 0.5} if u in bonus else {}
        for s, p, n in rows:
            if p in group:
                sums[group[p]] = sums.get(group[p], 0.0) + params.weight(s) * n
        best = sorted(sums, key=lambda k: (-round(sums[k], 12), k))[:3]
        if best:
            want_top[e] = {k: pytest.approx(sums[k] / sum(sums[b] for b in best)) for k in best}
        vectors = [(s, n, item[p]) for s, p, n in rows if p in item]
        said = [("search", 1, word[t]) for v, i, t in open_texts if v == u and i != 52 and not (i == 51 and own == 5)] + ([("chatbot", 1, word["y"])] if u == 2 and usable[e] else [])
        for want, parts in ((want_plain, vectors), (want_text, vectors + said)):
            signals = {s for s, _, _ in parts}
            if signals:
                mean = {s: sum(n * np.array(v) for k, n, v in parts if k == s) / sum(n for k, n, _ in parts if k == s) for s in signals}
                want[e] = pytest.approx(list(sum(params.weight(s) * m for s, m in mean.items()) / sum(params.weight(s) for s in signals)))
    assert top == want_top and plain == want_plain and with_text == want_text and len(plain) > 12


def test_names_of_left_out_examples_follow_users(spark):
    """200 examples of a user with 200 names: pairs of both are not shuffled."""
    *_, frames = _left_out(spark, {1: list(range(1, 202))})
    catalog = spark.createDataFrame([(p, f"n{p}") for p in range(1, 202)], "product_id bigint, kind string")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = loo.top_attributes(*frames, catalog, "kind", FeatureParams(), 5).collect()
    assert len(got) == 201 and all(len(r.top) == 5 for r in got)
    assert shuffled() - before < 10_000


def test_hot_users_are_counted_once_for_all_passes(spark, monkeypatch):
    """The passes of one training set share the users that are cut into days, and cut ones give the same rows."""
    from shelfwise.plans import examples, features
    from shelfwise.sources import bindings
    t = bindings.load(spark, "/root/testdata/sf0.001")
    cat = features.build_catalog(t, popularity=False)
    split = temporal.splits(t.events, t.users)
    calls, count = [], prefixes.hot_keys
    monkeypatch.setattr(prefixes, "hot_keys", lambda rows, keys, least: calls.append(1) or count(rows, keys, 50))
    te = examples.temporal_training(t, split, cat)
    cut = {r.example_id: r.vector for r in examples.temporal_features(t, te, cat).collect()}
    assert not te.hot.isEmpty() and len(calls) == 1 and len(cut) == te.examples.count()
    whole = dataclasses.replace(te, hot=te.hot.limit(0))
    assert cut == {r.example_id: r.vector and pytest.approx(r.vector, abs=1e-9) for r in examples.temporal_features(t, whole, cat).collect()}
