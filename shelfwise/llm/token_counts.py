"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For one pre-token let E(i) be the last token of the BPE encoding of its first i symbols, without a word end. A token t that
ends at i belongs to that encoding exactly if BPE keeps the pair (last token of E(i - |t|), t) apart; exactly one candidate
passes. So the encodings of all prefixes come from one pass, and a count at every prefix is the count before t plus one.
A prefix that ends a text also ends its word: its last token carries the word end and is found in the same way. The count
at any prefix of a text is then the sum over the pre-tokens before it plus the count of the cut pre-token's prefix, so
truncation and budget questions need no further encoding.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import wordbpe
from shelfwise.llm.arrow import per_batch, texts

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Contractions whose prefixes are no single pre-tokens.
_CUT_APART = frozenset(("'re", "'ve", "'ll"))


class PrefixCounts:
    """Token counts of prefixes for one vocabulary. Immutable but for bounded memos."""

    def __init__(self, name: str = VOCABULARY):
        self.words = wordbpe.words(name)
        self.longest = max(map(len, self.words.vocab))
        vocab = self.words.vocab
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in self.words.ranks}
        # Ids of merged tokens follow the merges' ranks, so a smaller id merges first. Single symbols part into themselves.
        self.parts = {i: (i, i) for i in vocab.values()}
        for (a, b), i in reversed(self.joined.items()):
            self.parts[i] = (a, b)
        self._apart = wordbpe.Memo(lambda pair: self.apart(pair >> 20, pair & 0xFFFFF))
        self.counts = wordbpe.Memo(lambda word: self._prefixes(word, False)[-1])
        self.tables = wordbpe.Memo(lambda word: self._prefixes(word, True))

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves two neighbouring tokens unmerged. Both are taken apart from the side of their boundary, the
        later merge first; they stay apart if no pair met on the way merges earlier than what was just taken apart."""
        joined, parts, earlier = self.joined, self.parts, 1 << 60
        while True:
            if joined.get((left, right), 1 << 60) < earlier:
                return False
            inner_left, inner_right = parts[left][1], parts[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or left > right and inner_left != left:
                earlier, left = left, inner_left
            else:
                earlier, right = right + 1, inner_right

    def _prefixes(self, word: str, every: bool) -> tuple[int, ...]:
        """Tokens of the first 1, 2, ... code points of a pre-token (or of all of it only), each read as a whole word."""
        if word in self.words.special:
            return (1,) * len(word)
        s, vocab, apart, end = self.words.symbols(word), self.words.vocab, self._apart, self.words.end
        n, longest = len(s), self.longest
        last, count = [-1], [0]

        def step(i: int, suffix: str) -> tuple[int, int]:
            for j in range(i - longest if i > longest else 0, i):
                t = vocab.get(s[j:i] + suffix)
                if t is not None and (not j or apart[last[j] << 20 | t]):
                    return t, count[j] + 1
            raise ValueError(f"no token ends the first {i} bytes of {word!r}")

        for i in range(1, n if not every else n + 1):
            t, c = step(i, "")
            last.append(t)
            count.append(c)
        if not every:
            return (step(n, end)[1],)
        return tuple(step(e, end)[1] for e in accumulate(len(c.encode()) for c in word))

    def total(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.words.split(text)))

    def inner(self, word: str) -> tuple[int, ...]:
        """Tokens of every prefix of a pre-token, cut as a text of its own is cut: a cut contraction is an apostrophe and letters."""
        if word in _CUT_APART:
            return tuple(sum(self.counts[w] for w in self.words.split(word[:n])) for n in range(1, len(word) + 1))
        return self.tables[word]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(code point where each pre-token ends, tokens up to there). Pre-tokens that come from one character are one."""
        ends, tokens, used = [], [], 0
        for word, end in self.words.spans(text):
            used += self.counts[word]
            if ends and ends[-1] == end:
                tokens[-1] = used
            else:
                ends.append(end)
                tokens.append(used)
        return ends, tokens

    def _inside(self, text: str, ends: list[int], tokens: list[int], k: int) -> list[int]:
        """Tokens of text[:n] for each n behind the end of pre-token k - 1 up to the end of pre-token k."""
        start, end = (ends[k - 1] if k else 0), ends[k]
        before, part = (tokens[k - 1] if k else 0), text[start:end]
        if self.words.plain(text):
            word = part.lower().lstrip()
            return [before] * (len(part) - len(word)) + [before + c for c in self.inner(word)]
        return self._recomposed(part, before, start > 0 and text[start - 1] == "'") or self._cut(text, ends, tokens, k)

    def _recomposed(self, part: str, before: int, quoted: bool) -> list[int] | None:
        """The same for a stretch in unusual characters that holds one pre-token: white space, then characters that the
        normaliser changes apart from each other. A cut inside of one continues the recurrence from the character before; not behind an
        apostrophe (`quoted`), with which a letter without its mark may be a contraction."""
        clean = self.words.tokenizer.normalizer.normalize_str
        lead = 0
        while lead < len(part) and not clean(part[lead]).strip(" "):
            lead += 1
        if part[lead:] in self.words.special:
            return None
        groups: list[tuple[str, str]] = []  # (characters, their normalised form)
        for c in part[lead:]:
            alone = clean(c)
            if groups:
                raw, form = groups[-1]
                both = clean(raw + c)
                if both != form + alone:
                    groups[-1] = raw + c, both
                    continue
            groups.append((c, alone))
        word = "".join(form for _, form in groups)
        if not word or self.words.split(word) != [word] or word in _CUT_APART or not all(form for _, form in groups):
            return None
        whole, out, at = self.tables[word], [before] * lead, 0
        parted = any(len(raw) > 1 for raw, _ in groups)
        if parted and quoted:
            return None
        states = self._states(word) if parted else None
        for raw, form in groups:
            for n in range(1, len(raw)):
                cut = clean(raw[:n])
                if self.words.split(word[:at][-1:] + cut) != [word[:at][-1:] + cut]:
                    return None
                out.append(before + self._close(*states, len(word[:at].encode()), self.words.symbols(cut)))
            at += len(form)
            out.append(before + whole[at - 1])
        return out

    def _cut(self, text: str, ends: list[int], tokens: list[int], k: int) -> list[int]:
        """The same by splitting each cut stretch anew, from a pre-token further on the left where k is a special string or stands
        behind an apostrophe, as a part of it may join the signs before."""
        b = k
        while b and (text[ends[b - 1]:ends[b]] in self.words.special or text[ends[b - 1] - 1] == "'"):
            b -= 1
        start, before = (ends[b - 1], tokens[b - 1]) if b else (0, 0)
        return [before + self.total(text[start:n]) for n in range((ends[k - 1] if k else 0) + 1, ends[k] + 1)]

    def _states(self, word: str) -> tuple[str, list[int], list[int]]:
        """(symbols, last token and number of tokens of each prefix of them, without a word end)."""
        s, last, count = self.words.symbols(word), [-1], [0]
        for i in range(1, len(s)):
            t, c = self._step(s, last, count, i, "", 0)
            last.append(t)
            count.append(c)
        return s, last, count

    def _step(self, s: str, last: list[int], count: list[int], i: int, suffix: str, base: int) -> tuple[int, int]:
        for j in range(max(0, i - self.longest), i):
            t = self.words.vocab.get(s[j:i] + suffix)
            if t is not None and (not base + j or self._apart[last[j] << 20 | t]):
                return t, count[j] + 1
        raise ValueError(f"no token ends {s[:i]!r}")

    def _close(self, s: str, last: list[int], count: list[int], at: int, more: str) -> int:
        """Tokens of the first `at` symbols and `more` read as a whole word; needs the last states only."""
        base = max(0, at - self.longest)
        s, last, count = s[base:at] + more, last[base:at + 1], count[base:at + 1]
        for i in range(at - base + 1, len(s)):
            t, c = self._step(s, last, count, i, "", base)
            last.append(t)
            count.append(c)
        return self._step(s, last, count, len(s), self.words.end, base)[1]

    def every(self, text: str) -> list[int]:
        """Tokens of text[:n] for n = 0, 1, ..., len(text)."""
        ends, tokens = self.table(text)
        out = [0]
        for k in range(len(ends)):
            out += self._inside(text, ends, tokens, k)
        return out + [out[-1]] * (len(text) + 1 - len(out))

    def at(self, text: str, length: int) -> int:
        """Tokens of text[:length], from the pre-tokens before and the prefixes of the one that is cut."""
        ends, tokens = self.table(text)
        k = bisect_left(ends, length)
        if length <= 0 or k == len(ends):
            return tokens[-1] if ends and length > 0 else 0
        return self._inside(text, ends, tokens, k)[length - 1 - (ends[k - 1] if k else 0)]

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens; it may end inside a pre-token."""
        ends, tokens = self.table(text)
        k = bisect_right(tokens, budget)
        if k == len(tokens):
            return len(text)
        start = ends[k - 1] if k else 0
        inside = self._inside(text, ends, tokens, k)
        return start + max((n for n, c in enumerate(inside, 1) if c <= budget), default=0)


@lru_cache(maxsize=4)
def prefix_counts(name: str = VOCABULARY) -> PrefixCounts:
    return PrefixCounts(name)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of `df`: id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest prefix
    within `limit`). NULL text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; an
    empty table gives none. Other columns are not read. Narrow: no shuffle."""

    def run(batch):
        p = prefix_counts(vocabulary)
        rows = texts(batch)
        tokens = [p.total(t) for t in rows]
        return {"id": batch.column("id"), "n_bytes": pa.array([len(t.encode()) for t in rows], "int64"), "n_tokens": pa.array(tokens, "int64"),
                "over_limit": [n > limit for n in tokens], "fit_chars": pa.array([p.fitting(t, limit) if n > limit else len(t) for t, n in zip(rows, tokens)], "int64")}

    kind = dict(df.dtypes)[id_column]
    return per_batch(df, {"id": id_column, "text": text_column}, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint").withColumnRenamed("id", id_column)


def prefix_tables(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The stored form: id, counts: the exact token count of text[:n] for n = 0, 1, ... up to the text's length. NULL and empty
    texts give [0]; repeated rows give repeated results, an empty table gives none. Other columns are not read. `tokens_at` and
    `fit_chars` answer from it."""

    def run(batch):
        return {"id": batch.column("id"), "counts": pa.array([prefix_counts(vocabulary).every(t) for t in texts(batch)], pa.list_(pa.int32()))}

    return per_batch(df, {"id": id_column, "text": text_column}, run, f"id {dict(df.dtypes)[id_column]}, counts array<int>").withColumnRenamed("id", id_column)


def tokens_at(counts: Column, length: Column) -> Column:
    """Tokens of the first `length` code points (of the whole text where it is shorter), from a stored row."""
    return F.element_at(counts, F.least(F.greatest(length, F.lit(0)) + 1, F.size(counts)))


def fit_chars(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix within `budget` tokens, from a stored row. Counts can fall from a prefix to a longer one, so it is the last that fits."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True)
