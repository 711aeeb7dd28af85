"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base rules find e-mail addresses, IP addresses, card and phone numbers, left to right, and drop a match that fails its check as a whole. Generators of high recall
propose overlapping spans inside and around such matches (runs of digit groups, addresses cut short, spelled-out addresses). Boosted trees score a
proposal by its format and context; they learn from the proposals of all rows that the base rules settle, so proposals
inside a dropped match are the ones they decide. A threshold per kind, calibrated on the held-out quarter of these, selects what is added to
the base spans. Spans are found per row inside arrays, and a text of any length is one row's work; only the counts of settled proposals by
features and label are shuffled, and the trees take them as weights.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.stage import stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Partitions of the counted proposals; their order is fixed, so that the fit is.
_FIT_PARTS = 8
#: Share of accepted held-out proposals that must be right.
PRECISION = 0.98
TREES, DEPTH = 12, 4

# The base patterns. Possessive runs and the start conditions find the same matches in linear time: a match
# starts where a run starts or where the match before it ended.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_HINTS = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9]")
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)++"
_WORDS = ((r"(?i)mail|contact|write", EMAIL), (r"(?i)\bip\b|host|server|addr", IP), (r"(?i)card|visa|credit|pay", CARD), (r"(?i)tel|phone|call|fax|mobil", PHONE))
FEATURES = ("kind", "digits", "groups", "luhn", "parts", "plus", "bracket", "dots", "hyphens", "spaces", "open_before", "open_after", "first_group", "longest_group", "lead", "word")
_BLOCK = 256
#: Digits of an address, a card and a phone number; a group has at least one, so the most is also the most groups.
_DIGITS = {IP: (4, 12), CARD: (12, 19), PHONE: (9, 15)}
_GROUPS = max(most for _, most in _DIGITS.values())
_LEAST = min(least for least, _ in _DIGITS.values())


def _running(lengths: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that long arrays are not copied for every element."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    start = F.struct(F.lit(0).alias("t"), F.expr("cast(array() as array<array<int>>)").alias("o"))

    def inner(block, total):
        first = F.struct(total.alias("t"), F.expr("cast(array() as array<int>)").alias("o"))
        return F.aggregate(block, first, lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"] + x)).alias("o")), lambda a: a["o"])

    out = F.aggregate(blocks, start, lambda acc, block: F.struct((acc["t"] + F.aggregate(block, F.lit(0), lambda a, x: a + x)).alias("t"),
                                                                 F.concat(acc["o"], F.array(inner(block, acc["t"]))).alias("o")))
    return F.when(n > 0, F.flatten(out["o"])).otherwise(F.expr("cast(array() as array<int>)"))


def _with_matches(df: DataFrame, name: str, pattern: str, where: Column) -> DataFrame:
    """Adds array `name` of (s, e, m, pre, post): code points of each match, its text, the text before up to the last match
    (its last 24 characters) and the first characters after."""
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string,pre:string,gap:int,post:string>>)")
    df = df.withColumn("_ms", F.when(where, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))).withColumn("_segs", F.when(F.size("_ms") > 0, F.split("_text", pattern, -1)))
    df = df.withColumn("_ends", F.when(F.col("_segs").isNotNull(), _running(F.zip_with("_ms", F.slice("_segs", 1, F.size("_ms")), lambda m, g: F.length(m) + F.length(g)))))
    each = F.transform("_ms", lambda m, i: F.struct((F.element_at("_ends", i + 1) - F.length(m)).alias("s"), F.element_at("_ends", i + 1).alias("e"), m.alias("m"),
                                                    F.right(F.element_at("_segs", i + 1), F.lit(24)).alias("pre"), F.length(F.element_at("_segs", i + 1)).alias("gap"),
                                                    F.substring(F.element_at("_segs", i + 2), 1, 4).alias("post")))
    return df.withColumn(name, F.when(F.col("_ends").isNotNull(), each).otherwise(empty)).drop("_ms", "_segs", "_ends")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """For strings of at most 19 digits."""
    n = F.length(digits)

    def at(i):
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + at(i))
    return n.between(12, 19) & (F.when(n.between(12, 19), total).otherwise(1) % 10 == 0)


def _small_parts(text: Column) -> Column:
    return text.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def _passes(kind: int, m: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return _small_parts(m)
    if kind == CARD:
        return _luhn(_digits(m))
    return F.length(_digits(m)).between(9, 15)


def _base(df: DataFrame) -> DataFrame:
    """Adds `_base` and `_dropped`: arrays of (s, k, e), the passing and the failing matches of all kinds."""
    text = F.col("_text")
    for k, pattern in enumerate(PATTERNS):
        hint = F.contains(text, F.lit("@")) if k == EMAIL else text.rlike(_HINTS[k])
        df = _with_matches(df, f"_m{k}", pattern, hint)

    def spans(kind, wanted):
        chosen = F.filter(f"_m{kind}", lambda m: _passes(kind, m["m"]) == wanted)
        return F.transform(chosen, lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))

    good, bad = [spans(k, True) for k in range(4)], [spans(k, False) for k in (IP, CARD, PHONE)]
    return df.withColumn("_base", F.array_sort(F.concat(*good))).withColumn("_dropped", F.concat(*bad)).drop(*[f"_m{k}" for k in range(4)])


def _proposals(df: DataFrame) -> DataFrame:
    """Adds `_seen`: array of (k, s, e, f), overlapping proposals with their features. Only rows that have base spans or
    dropped matches, or digits in a row like those of a number, propose any."""
    text = F.col("_text")
    some = (F.size("_base") > 0) | (F.size("_dropped") > 0) | text.rlike(r"[0-9](?:[ ().+-]{0,3}[0-9]){8}") | text.rlike(r"\((?:at)\)|\[(?:at)\]")
    df = _with_matches(df, "_g", "[0-9]++", some)
    df = _with_matches(df, "_at", _SPELLED, some & text.rlike(r"\(at\)|\[at\]"))
    groups = F.col("_g")

    def proposal(i, k):
        part = F.slice(groups, i + 1, k + 1)
        inner = F.slice(groups, i + 2, k)
        return F.struct(part.alias("part"), F.array_join(F.transform(inner, lambda h: h["pre"]), "|").alias("seps"), F.array_join(F.transform(part, lambda h: h["m"]), "").alias("d"),
                        F.element_at(part, 1).alias("a"), F.element_at(part, -1).alias("z"), (k + 1).alias("n"))

    reach = F.transform(groups, lambda g, i: F.filter(F.sequence(F.lit(0), F.least(F.lit(_GROUPS - 1), F.size(groups) - i - 1)),
                                                      lambda k: F.forall(F.slice(groups, i + 2, k), lambda h: (h["gap"] <= 3) & h["pre"].rlike(r"^[ ().+-]{1,3}$"))
                                                      & F.aggregate(F.slice(groups, i + 1, k + 1), F.lit(0), lambda a, h: a + F.length(h["m"])).between(_LEAST, _GROUPS)))
    df = df.withColumn("_p", F.flatten(F.transform(reach, lambda ks, i: F.transform(ks, lambda k: proposal(i, k)))))
    plus = lambda p: p["a"]["pre"].rlike(r"\+$")
    sized = lambda p, kind: F.length(p["d"]).between(*_DIGITS[kind])
    shapes = ((IP, lambda p: sized(p, IP) & (p["n"] == 4) & (p["seps"] == ".|.|.")),
              (CARD, lambda p: sized(p, CARD) & p["seps"].rlike(r"^[ |-]*$")),
              (PHONE, lambda p: sized(p, PHONE) & (plus(p) | p["seps"].rlike(r"^[ ().|-]+$"))))

    def features(kind, p, start_plus):
        before = F.when(start_plus, F.substring(p["a"]["pre"], 1, F.length(p["a"]["pre"]) - 1)).otherwise(p["a"]["pre"])
        count = lambda c: F.length(p["seps"]) - F.length(F.replace(p["seps"], F.lit(c), F.lit("")))
        word = reduce(lambda a, w: F.when((F.lit(w[1]) == kind) & before.rlike(w[0]), 1.0).otherwise(a), _WORDS, F.lit(0.0))
        values = (F.lit(kind), F.length(p["d"]), p["n"], _luhn(p["d"]), F.forall(p["part"], lambda h: (F.length(h["m"]) <= 3) & (F.coalesce(h["m"].try_cast("int"), F.lit(999)) <= 255)),
                  start_plus, p["seps"].rlike(r"[()]"), count("."), count("-"), count(" "), ~before.rlike(r"[0-9A-Za-z._+-]$|[0-9][ .-]$"), ~p["z"]["post"].rlike(r"^[0-9A-Za-z_]|^[ .-][0-9]"),
                  F.length(p["a"]["m"]), F.array_max(F.transform(p["part"], lambda h: F.length(h["m"]))), F.substring(p["d"], 1, 1).cast("int"), word)
        return F.array(*[v.cast("double") for v in values])

    def as_spans(kind, shape):
        chosen = F.filter("_p", shape)
        add = (lambda p: plus(p)) if kind == PHONE else (lambda p: F.lit(False))
        return F.transform(chosen, lambda p: F.struct(F.lit(kind).alias("k"), (p["a"]["s"] - add(p).cast("int")).alias("s"), p["z"]["e"].alias("e"), features(kind, p, add(p)).alias("f")))

    df = _with_matches(df, "_mail", PATTERNS[EMAIL], some & F.contains(text, F.lit("@")))

    def mail(m, cut=False):
        """An address as a proposal; `cut`: without its last label, which the base rule never gives."""
        drop = F.length(F.regexp_extract(m["m"], r"\.[^.]*$", 0)) if cut else F.lit(0)
        return F.struct(F.lit(EMAIL).alias("k"), m["s"].alias("s"), (m["e"] - drop).alias("e"), address(m, drop).alias("f"))

    def address(m, drop):
        """Features of an address once its spelled signs are undone; the places of FEATURES that make no sense for it hold others: labels, whole
        (in place of the checksum), tail of two letters or more, name's length, longest label, tail's length."""
        whole = F.regexp_replace(F.regexp_replace(m["m"], r" ?[(\[]at[)\]] ?", "@"), r" ?[(\[]dot[)\]] ?", ".")
        found = F.substring(whole, F.lit(1), F.length(whole) - drop)
        labels = F.split(F.substring_index(found, "@", -1), r"\.")
        tail = F.element_at(labels, -1)
        count = lambda c: F.length(found) - F.length(F.replace(found, F.lit(c), F.lit("")))
        values = (F.lit(EMAIL), F.length(_digits(found)), F.size(labels), (drop == 0) & ~m["post"].rlike("^[0-9A-Za-z_@]"), (F.size(labels) > 1) & tail.rlike("^[A-Za-z]{2,}$"), F.lit(0), F.lit(0), count("."), count("-"), F.lit(0),
                  ~m["pre"].rlike(r"[0-9A-Za-z._%+-]$"), F.lit(1), F.length(F.substring_index(found, "@", 1)),
                  F.array_max(F.transform(labels, lambda x: F.length(x))), F.length(tail), m["pre"].rlike(_WORDS[EMAIL][0]))
        return F.array(*[v.cast("double") for v in values])

    mails = [F.transform("_mail", lambda m: mail(m)), F.transform("_mail", lambda m: mail(m, True)), F.transform("_at", lambda m: mail(m))]
    return df.withColumn("_seen", F.concat(*mails, *[as_spans(k, shape) for k, shape in shapes])).drop("_g", "_at", "_p", "_mail")


def _labelled(df: DataFrame) -> DataFrame:
    """(f, label, held, n): how many proposals of these features there are among those that the base rules settle: those that are a base span (1), and others (0) unless they
    lie strictly inside a dropped match or are addresses apart from all base spans: no base rule speaks of spelled ones."""
    # The outer form: Spark derives no filter from it, which would repeat the whole expression of `_seen`.
    rows = df.select("_key", "_base", "_dropped", F.explode_outer("_seen").alias("c"))
    inside = F.exists("_dropped", lambda d: (d["s"] <= F.col("c.s")) & (F.col("c.e") <= d["e"]) & (d["e"] - d["s"] > F.col("c.e") - F.col("c.s")))
    hit = F.exists("_base", lambda b: (b["k"] == F.col("c.k")) & (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e")))
    near = F.exists("_base", lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    rows = rows.select(F.xxhash64("_key", "c.s", "c.e", "c.k").alias("h"), F.col("c.f").alias("f"), hit.cast("double").alias("label"), (hit | ~inside & ((F.col("c.k") != EMAIL) | near)).alias("known"))
    rows = rows.where("known AND f IS NOT NULL").select("f", "label", (F.pmod("h", F.lit(4)) == 0).alias("held"))
    return rows.groupBy("f", "label", "held").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _tree_columns(model) -> list[tuple[float, str]]:
    """(weight, SQL over array `f`) of each tree, from the fitted model's printed form."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees):
        lines = [line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()]

        def node(at: int) -> tuple[str, int]:
            if lines[at].startswith("Predict"):
                return f"{float(lines[at].split(':')[1])}D", at + 1
            feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
            left, at = node(at + 1)
            right, at = node(at + 1)
            return f"CASE WHEN f[{feature}] <= {float(limit)}D THEN {left} ELSE {right} END", at

        out.append((weight, node(0)[0]))
    return out


def _fit(settled: DataFrame) -> tuple[str | None, dict[int, float]]:
    """SQL for a proposal's probability over array `f`, and the threshold of each kind that has one."""
    settled = stage(settled, "pii_settled").repartition(_FIT_PARTS, "f").sortWithinPartitions("f", "label", "held")
    labels = {r["label"] for r in settled.where("NOT held").select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return None, {}
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=5, featuresCol="v", labelCol="label", weightCol="n").fit(settled.where("NOT held").select(array_to_vector("f").alias("v"), "label", "n"))
    score = " + ".join(f"{weight}D * ({sql})" for weight, sql in _tree_columns(model))
    probability = f"1D / (1D + exp(-2D * ({score})))"
    held = settled.where("held").select(F.col("f")[0].cast("int").alias("k"), F.round(F.expr(probability), 6).alias("p"), "label", "n")
    steps = held.groupBy("k", "p").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()  # a few distinct scores: each comes from a leaf of every tree
    limits = {}
    for k in range(4):
        n = good = 0
        ordered = sorted((r for r in steps if r["k"] == k), key=lambda r: -r["p"])
        for r, lower in zip(ordered, [*[r["p"] for r in ordered[1:]], 0.0]):
            n, good = n + r["n"], good + r["right"]
            if r["p"] >= 0.5 and good / n >= PRECISION:
                limits[k] = max(0.5, (r["p"] + lower) / 2)  # half way to the next score that was met
    return probability, limits


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `df`: id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans (base and added): arrays of
    (s, k, e), s and e in code points, end exclusive, k a position in KINDS; then the columns in `carry`.

    NULL text counts as empty: no spans. Added spans overlap neither base spans nor each other. Without rows, or without
    settled proposals of both labels, nothing is added. Repeated rows give repeated results; NULL ids are kept."""
    carry = list(carry or [])
    rows = df.select(F.col(id_column).alias("_key"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    probability, limits = _fit(_labelled(_proposals(_base(rows.select("_key", "_text")))))
    rows = _proposals(_base(rows))
    spans = F.col("_base")
    if limits:
        passing = f"filter(_seen, x -> element_at(transform(array(x.f), f -> {probability}), 1) >= CASE x.k " + " ".join(f"WHEN {k} THEN {v}D" for k, v in limits.items()) + " ELSE 2D END)"
        rows = rows.withColumn("_pass", F.expr(passing))
        clear = F.filter("_pass", lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        ordered = F.array_sort(F.transform(clear, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("r"), c["k"].alias("k"))))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)").alias("o"))
        swept = F.aggregate(ordered, start, lambda a, c: F.when(c["s"] >= a["at"], F.struct((-c["r"]).alias("at"), F.concat(a["o"], F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), (-c["r"]).alias("e")))).alias("o"))).otherwise(a))
        spans = F.when(F.size("_pass") > 0, F.array_sort(F.concat("_base", swept["o"]))).otherwise(F.col("_base"))
    counts = [F.size(F.expr(f"filter(_base, b -> b.k = {k})")).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    # A row number among the results stops Spark from moving a caller's filter below them, which would repeat all of the above.
    rows = rows.select("_key", *counts, F.col("_base").alias("base_spans"), spans.alias("spans"), *[f"_c{i}" for i in range(len(carry))], F.monotonically_increasing_id().alias("_row"))
    held = [F.when(F.col("_row") >= 0, F.col(c)).alias(c) for c in ("base_spans", "spans")]
    return rows.select(F.col("_key").alias(id_column), *[f"n_{name}" for name in KINDS], *held, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    return _joined(spans)


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets. Of overlapping spans the first is replaced, and the next
    from where it ended."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("o"))
    walk = F.aggregate(spans, start, lambda a, x: F.when(x["e"] > a["at"], F.struct(x["e"].alias("at"), F.concat(a["o"], F.array(
        F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))), F.element_at(names, x["k"] + 1))).alias("o"))).otherwise(a))
    rest = F.substring(text, walk["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(walk["o"], ""), rest)).otherwise(text)


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`df` with its columns and the spans in its texts replaced. NULL text stays NULL."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    text = f"c{df.columns.index(text_column)}"
    found = find(plain, f"c{df.columns.index(id_column)}", text, plain.columns)
    kept = found.toDF(*[f"_{i}" for i in range(len(found.columns) - len(plain.columns))], *plain.columns)
    spans = f"_{found.columns.index('spans')}"
    return kept.withColumn(text, redacted(F.col(text), F.col(spans))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
