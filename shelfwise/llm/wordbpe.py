"""Word-level BPE with word ends: cuts a text into pre-tokens and encodes each one once.

Texts in plain Latin letters are cut by one compiled pattern; any other text is cut by the tokenizer's own normaliser and
pre-tokenizer, so the pre-tokens are always those of the library.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import getsizeof

# The pre-token pattern of the vocabulary, written for lower-case ASCII and Latin letters up to U+017F.
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ňŊ-ſ‐-‧€]")

#: Bytes that remembered words and their results may take in a worker, about; a word that would take more than a hundredth isn't kept.
CACHED_BYTES = 80 << 20
_ENTRY_BYTES = 100


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer in file `name`: a path, or the name of a file of the installed public vocabularies."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


class Memo(dict):
    """Remembers the results of `fn`, starting afresh when full, so its memory is bounded."""

    def __init__(self, fn: Callable, limit: int = CACHED_BYTES):
        super().__init__()
        self.fn, self.limit, self.held = fn, limit, 0

    def __missing__(self, key):
        value = self.fn(key)
        size = _ENTRY_BYTES + getsizeof(key) + getsizeof(value)
        if 100 * size > self.limit:
            return value
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


class Words:
    """Pre-tokens of whole texts for one vocabulary file."""

    def __init__(self, name: str):
        self.tokenizer = load(name)
        import json
        spec = json.loads(self.tokenizer.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._bytes = _byte_symbols()

    def plain(self, text: str) -> bool:
        return not _UNUSUAL.search(text) and "<|" not in text

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order. Special strings come out as themselves and are told apart by `special`."""
        if self.plain(text):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                clean = self.tokenizer.normalizer.normalize_str(part)
                out += [self._text(symbols) for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
        return out

    def spans(self, text: str) -> Iterator[tuple[str, int]]:
        """Pre-tokens with the code point where each ends in the given text. Pre-tokens that the normaliser makes out of
        the same code points, or parts by a combining mark, have one end."""
        if self.plain(text):
            for m in _WORD.finditer(text.lower()):
                yield m.group(), m.end()
            return
        at = 0
        for part in self._special.split(text):
            if part in self.special:
                yield part, at + len(part)
            elif part:
                e = self.tokenizer.encode(part, add_special_tokens=False)
                clean = self.tokenizer.normalizer.normalize_str(part)
                words = [self._text(symbols) for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
                starts: dict[int, int] = {}
                ends: dict[int, int] = {}
                for word, (start, end) in zip(e.word_ids, e.offsets):
                    starts[word] = min(start, starts.get(word, start))
                    ends[word] = max(end, ends.get(word, 0))
                order, limit, out = sorted(ends), len(part), []
                for k in reversed(order):
                    end = ends[k]
                    while end < limit and self.tokenizer.normalizer.normalize_str(part[end]).strip(" "):
                        end += 1  # composed with the character before; the library's offsets name that one only
                    if out and (limit < end or limit == end and self._mixes(part[end - 1], part[end])):
                        end = out[-1]  # the next one starts within this one's last character, or is mixed with it
                    out.append(end)
                    limit = starts[k]
                for word, end in zip(words, reversed(out), strict=True):
                    yield word, at + end
            at += len(part)

    def _mixes(self, before: str, after: str) -> bool:
        clean = self.tokenizer.normalizer.normalize_str
        return unicodedata.combining(after) > 0 or clean(before + after) != clean(before) + clean(after)

    def symbols(self, word: str) -> str:
        """One character for each byte of a pre-token."""
        return "".join(self._bytes[b] for b in word.encode())

    def _text(self, symbols: str) -> str:
        back = {c: b for b, c in enumerate(self._bytes)}
        return bytes(back[c] for c in symbols).decode()

    def ids(self, word: str) -> list[int]:
        """Token ids of one pre-token, by the library's model."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(self.symbols(word))]


def _byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def words(name: str) -> Words:
    return Words(name)


@lru_cache(maxsize=4)
def id_bytes(name: str) -> Memo:
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; kept by the worker between tasks."""
    import struct
    w = words(name)
    return Memo(lambda word: struct.pack(f"<{len(ids := w.ids(word))}I", *ids))


def encode(name: str, text: str | None) -> bytes:
    """All ids of a whole text, without begin or end, as little-endian unsigned 32-bit integers."""
    return b"".join(map(id_bytes(name).__getitem__, words(name).split(text))) if text else b""
