"""Language identification by Bayesian evidence fusion.

Evidence for the language of a text: its byte trigrams (naive Bayes, fitted on a bounded sample of each language's labelled rows), the
language that its markup declares, the suffix of its address, and the languages of its host. The last three are learned
from the corpus itself by grouped aggregation of the texts' own posteriors: how often each declared value and each suffix
comes with each language, and a host's mix of languages, smoothed towards its suffix and that towards the whole. All are
added as log probabilities.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import _quoted, per_batch, slices, texts
from shelfwise.sources.stage import stage

#: Labelled rows of each language that the trigram model is fitted on, about so many at most: those whose hash is below a limit.
SAMPLE_ROWS = 4_000
_BITS = 16
#: Trigrams looked up at once.
_BLOCK = 1 << 16
#: Strength of a prior: so many texts of the level above count as much as a group's own.
STRENGTH = 20.0
#: Posterior probability below which a language stays undecided.
CONFIDENT = 0.5
#: Trigrams in a text are far from independent; its log likelihood counts as that of this many at most.
EFFECTIVE = 60.0
#: Texts with fewer letters than this have no language.
LETTERS = 2

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
# ASCII bytes other than letters are one symbol, so that numbers and marks say nothing about a language.
_FOLD[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def _trigrams(data: bytes) -> np.ndarray:
    """Bucket of each three bytes in a row that hold a letter; runs of other characters count once."""
    b = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    g = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (g * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


class Trigrams:
    """Log probabilities by bucket and language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + 0.5
        self.log = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, text: str) -> list[float] | None:
        """Log likelihood of the text for each language, scaled to at most EFFECTIVE trigrams; None without letters."""
        g = _trigrams(text.encode())
        if len(g) < LETTERS or not any(c.isalpha() for c in text):
            return None
        total = sum(self.log[:, g[at:at + _BLOCK]].sum(axis=1, dtype=np.float64) for at in range(0, len(g), _BLOCK))
        return (total / len(g) * min(len(g), EFFECTIVE)).tolist()


def fit(labelled: DataFrame, text_column: str, label_column: str, id_column: str | None = None) -> Trigrams:
    """Trigram counts of a bounded sample of every label, of the whole label where it is small: tasks count their own rows, and one
    small table per task comes back. Rows are chosen by their ids, or by their texts without an `id_column`."""
    rows = labelled.select(F.col(_quoted(text_column)).alias("text"), F.col(_quoted(label_column)).alias("label"), F.xxhash64(F.col(_quoted(id_column or text_column))).alias("key")).where("text IS NOT NULL AND label IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    limits = [(label, int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))) for label, n in sizes.items() if n > SAMPLE_ROWS]
    if limits:
        limit = F.coalesce(F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("label")], F.lit(1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < limit)
    sample = stage(rows.select("text", "label"), "language_sample")

    def run(batches):
        counts = {label: np.zeros(1 << _BITS, np.int64) for label in labels}
        for batch in slices(batches):
            for label, text in zip(batch.column("label").to_pylist(), texts(batch)):
                counts[label] += np.bincount(_trigrams(text.encode()), minlength=1 << _BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["label", "counts"])

    total = np.zeros((len(labels), 1 << _BITS))
    for row in sample.coalesce(2).mapInArrow(run, "label string, counts binary").collect():
        total[labels.index(row["label"])] += np.frombuffer(bytes(row["counts"]), np.int64)
    return Trigrams(labels, total)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def declared_in(html: Column) -> Column:
    """Primary language tag of the root element; '' without one, NULL for NULL."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def text_of(html: Column) -> Column:
    """What is left of a page without scripts, styles, tags and character references."""
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(shown, r"<[^>]*>|&#?[A-Za-z0-9]+;", " ")


def _normal(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def identify(df: DataFrame, model: Trigrams, id_column: str, text_column: str, declared_column: str | None = None, host_column: str | None = None, suffix_column: str | None = None) -> DataFrame:
    """One row per row of `df`: id, language, probability, text_language (by its text alone), accepted.

    `accepted` is false, and language NULL, for texts without letters (NULL and empty ones too) and where no language reaches
    CONFIDENT. Of equally likely languages the first by name counts. Missing or unknown declared values, suffixes and hosts are
    evidence of their own kind, learned like others. Repeated rows give repeated results, NULL ids stay, other columns are not
    read. An empty table gives no rows."""
    found = _judged(df, model, text_column, declared_column, host_column, suffix_column, [id_column])
    return found.select(F.col("c0").alias(id_column), "language", "probability", "text_language", "accepted")


def accepted(df: DataFrame, model: Trigrams, text_column: str, declared_column: str | None = None, host_column: str | None = None, suffix_column: str | None = None) -> DataFrame:
    """The rows of `df` that `identify` accepts, with all their columns and no others, whatever their names."""
    found = _judged(df, model, text_column, declared_column, host_column, suffix_column, df.columns).where("accepted")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def _judged(df: DataFrame, model: Trigrams, text_column: str, declared_column: str | None, host_column: str | None, suffix_column: str | None, carry: list[str]) -> DataFrame:
    """(language, probability, text_language, accepted) and the columns in `carry` as c0, c1, ... per row of `df`."""
    k = len(model.languages)
    log, languages = model.log, model.languages

    carried = [f"c{i}" for i in range(len(carry))]
    # a text that is carried is sent to the workers once
    text = carried[carry.index(text_column)] if text_column in carry else "text"

    def run(batch):
        m = Trigrams.__new__(Trigrams)
        m.log, m.languages = log, languages
        return {**{n: batch.column(n) for n in batch.schema.names if n != "text"}, "scores": pa.array([m.scores(t) for t in texts(batch, text)], pa.list_(pa.float64()))}

    def evidence(column):
        return F.coalesce(F.col(_quoted(column)).cast("string"), F.lit("")) if column else F.lit("")

    own = [] if text in carried else [F.col(_quoted(text_column)).alias("text")]
    source = df.select(*own, evidence(declared_column).alias("declared"), evidence(host_column).alias("host"), evidence(suffix_column).alias("suffix"),
                       *[F.col(_quoted(c)).alias(n) for c, n in zip(carry, carried)])
    if not k:
        return source.select(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"), *carried)
    kinds = dict(source.dtypes)
    schema = "declared string, host string, suffix string, scores array<double>" + "".join(f", {c} {kinds[c]}" for c in carried)
    scored = stage(per_batch(source, {c: c for c in source.columns}, run, schema), "text_scores")
    posterior = scored.where("scores IS NOT NULL").withColumn("p", _normal(F.col("scores")))
    sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(k)]
    by_host = stage(posterior.groupBy("host", "suffix", "declared").agg(*sums, F.count(F.lit(1)).alias("n")), "host_languages")
    cols = [f"p{i}" for i in range(k)]
    add = [F.sum(c).alias(c) for c in cols] + [F.sum("n").alias("n")]
    total = by_host.agg(*add).first()
    whole = [(total[c] or 0.0) / max(total["n"] or 0, 1) for c in cols]
    whole = [(w + 1e-6) / (sum(whole) + k * 1e-6) for w in whole]

    def level(keys, above):
        """Language mix of each group, smoothed towards the level above, as columns q0, q1, ..."""
        rows = by_host.groupBy(*keys).agg(*add)
        if above is not None:
            rows = rows.join(above, keys[:-1], "left")
        up = [F.col(f"u{i}") if above is not None else F.lit(whole[i]) for i in range(k)]
        return rows.select(*keys, *[((F.col(f"p{i}") + STRENGTH * up[i]) / (F.col("n") + STRENGTH)).alias(f"q{i}") for i in range(k)])

    suffixes = level(["suffix"], None)
    hosts = level(["suffix", "host"], suffixes.select("suffix", *[F.col(f"q{i}").alias(f"u{i}") for i in range(k)]))
    # P(declared | language), with one text's worth of every value for every language.
    values = by_host.groupBy("declared").agg(*add)
    of_language = [max(total[c] or 0.0, 1e-6) for c in cols]
    declared = values.select("declared", F.array(*[F.log((F.col(f"p{i}") + F.lit(whole[i])) / (of_language[i] + STRENGTH)) for i in range(k)]).alias("said"))
    # Both staged, so that Spark can split the join of a very common host or declared value.
    prior = stage(hosts.select("suffix", "host", F.array(*[F.log(f"q{i}") for i in range(k)]).alias("prior")), "host_priors")
    declared = stage(declared, "declared_languages")
    joined = scored.join(prior, ["suffix", "host"], "left").join(declared, "declared", "left")
    fused = F.zip_with(F.zip_with("scores", F.coalesce("prior", F.array(*[F.lit(float(np.log(w))) for w in whole])), lambda a, b: a + b),
                       F.coalesce("said", F.array(*[F.lit(0.0)] * k)), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda scores: F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    out = joined.withColumn("fused", fused).withColumn("probability", F.coalesce(F.array_max(_normal(F.col("fused"))), F.lit(0.0)))
    sure = F.col("fused").isNotNull() & (F.col("probability") >= CONFIDENT)
    return out.select(F.when(sure, best(F.col("fused"))).alias("language"), "probability", best(F.col("scores")).alias("text_language"), sure.alias("accepted"), *carried)
