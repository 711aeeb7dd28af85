"""Small tables and brute-force versions shared by these tests."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: NULL and empty texts, NULL ids, ties, repeated rows, a long text, unusual characters, and columns whose names clash with those used inside.
TEXTS = [
    (1, "The cat sat on the mat and looked at the door for a while."),
    (2, "The cat  sat on\nthe mat and looked at the door for a while."),
    (3, "Der Hund schläft heute nicht, weil die Katze im Garten über die Straße läuft."),
    (4, None), (5, ""), (6, " \t\n "), (7, "Le chat est très élégant et l'école est fermée à midi."),
    (8, "call +1 (555) 010-9999 or a.b@x.example.com, card 4111 1111 1111 1111, ip 10.0.0.255!"),
    (9, "don't \\ stop <|end|> </s>[INST] ok [/INST] 日本語 ΟΔΟΣ ½ 12"), (10, "x" * 30_000), (11, "word " * 9_000),
    (12, "one two three"), (13, "One two THREE"), (13, "One two THREE"), (None, "no id at all here"), (None, None), (15, "0" * 9_000), (16, "1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 2"),
]


def table(spark, rows=TEXTS):
    """`rows` as documents with further columns of awkward names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, _id string, row int, key string, n int, _key string, _text string, _c0 string, c1 string, `odd name` int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "a", 1, "k", 2, "kk", "tt", "c", "d", 3) for i, t in rows], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_components(rows, width, percent=80):
    """(id -> smallest id reachable) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, width))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
