"""Word caches over a published tokenizer.

A byte-level tokenizer splits a text by a fixed pattern and merges within each match, so the ids of
a text are the ids of its matches in order. Each Python worker keeps the ids of the words it has met.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import regex

#: Words kept by one Python worker, about 250 bytes each; the cache starts anew beyond it.
CACHED_WORDS = 400_000
#: Longer matches are encoded each time.
CACHED_CHARS = 48
#: Longer texts aren't given to the faster engine.
FAST_CHARS = 200_000

#: The pattern that splits texts for the byte-level vocabularies (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space among the first 256 characters, for the faster engine below.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"


def splitter(pattern: str = BYTE_LEVEL) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text. Texts of Latin-1 characters go through ``re``, twice as fast."""
    slow = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return slow
    fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return slow(text)
        return fast(text)

    return split


class WordCache(dict):
    """Word to what ``encode`` gives for it; ``split`` cuts texts into words."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list], most: int = CACHED_WORDS):
        super().__init__()
        self.split, self.encode, self.most = split, encode, most

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them in the cache until ``done``."""
        if len(self) > self.most:
            self.clear()
        split = [self.split(text) for text in texts]
        new = list(set().union(*split).difference(self))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.update(zip(some, self.encode(some)))
        self.long = [w for w in new if len(w) > CACHED_CHARS]
        return split

    def done(self) -> None:
        for word in self.long:
            del self[word]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonTokens:
    """Ids of a ``tokenizers`` file with byte-level pre-tokenization.

    With ``special`` the strings of the file's added tokens (such as ``<|endoftext|>``) are those tokens wherever a
    text has them, as the library itself reads them; without, they are ordinary text, so that no document can
    hold the id of a separator.
    Texts of Latin-1 characters go through the ``tiktoken`` engine with the ranks of the file's own
    vocabulary, which gives the same ids several times faster; all others (where the engines' Unicode
    tables could differ) and very long ones go through ``tokenizers``, word by word and cached.
    """

    def __init__(self, path: str, pattern: str = BYTE_LEVEL, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task its core
        import tiktoken
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.normalizer is not None:
            raise ValueError(f"{path}: texts can't be cut into words before they are normalised")
        self.inner.encode_special_tokens = True
        self.cache = WordCache(splitter(pattern), self._ids)
        added = {t.content for t in self.inner.get_added_tokens_decoder().values()}
        self.marked = re.compile("|".join(map(re.escape, sorted(added)))).search if special and added else None
        self.whole = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in self.inner.get_vocab().items() if t not in added}
        self.fast = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _ids(self, words: list[str]) -> list[bytes]:
        out = []
        for x in self.inner.encode_batch_fast(words, add_special_tokens=False):
            ids = x.ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _slow(self, text: str) -> bytes:
        split = self.cache.words([text])
        out = b"".join(map(self.cache.__getitem__, split[0]))
        self.cache.done()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if self.marked and self.marked(text):  # texts with a special token's string go to the library whole
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
                continue
            fine = len(text) <= FAST_CHARS
            if fine:
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    fine = False
            out.append(self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if fine else self._slow(text))
        return out


_OPEN: dict[tuple[str, str, bool], JsonTokens] = {}


def json_tokens(path: str, pattern: str = BYTE_LEVEL, special: bool = False) -> JsonTokens:
    """One ``JsonTokens`` a Python worker, file and reading of special tokens."""
    name = (path, pattern, special)
    if name not in _OPEN:
        _OPEN[name] = JsonTokens(*name)
    return _OPEN[name]
