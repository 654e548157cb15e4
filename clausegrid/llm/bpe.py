"""Byte-level BPE as a lazily determinised finite-state transducer (operator 10).

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is the
encoding of its own bytes, so the last token of every prefix is unique and a finite amount of
look-ahead settles each token. A state of the transducer holds the positions that may still become
a boundary, each as a node of the vocabulary's trie and the last token before it; positions whose node
dies drop out, and tokens on which all that are left agree are emitted. States and transitions are
made on first use and then looked up (subset construction on demand). The longest token bounds the
look-ahead. Decoding joins the tokens' bytes; a UTF-8 state machine that steps by whole tokens, its
transitions also made on first use, gives text and says where a code point is still open.

Defined results: a null text is an empty one (0 ids). Bytes that are no valid UTF-8 decode to U+FFFD
as text; as bytes they round-trip. Repeated rows give repeated results; extra columns are kept by
``encode_column`` and left out by the query. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import bound_batches, id_column, ids_back, text_of, with_arrays
from .tokens import BYTE_LEVEL, CACHED_WORDS, WordCache, splitter

#: States and pairs that one worker keeps; the transducer starts anew beyond them.
MAX_STATES, MAX_PAIRS = 400_000, 1_000_000
_REPLACEMENT = "�"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank, one pair a line. The vocabulary's size bounds it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes the bytes of one pattern match; ``Feed`` gives tokens as soon as they are settled."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = [0] * (max(ranks.values()) + 1)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            self.length[rank] = len(token)
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][b]
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        #: A state: (node, last token before the position, -1: none) of each open position, oldest first.
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """The definition itself, for the bytes of two tokens: join the neighbouring pair of lowest rank, leftmost first."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        while joined and (least := min(joined)) < 1 << 40:
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], 1 << 40)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], 1 << 40)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: stand first)."""
        got = self.pairs.get((left, right))
        if got is None:
            before = self.bytes_of[left] if left >= 0 else b""
            got = self.merged(before + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
            self.pairs[left, right] = got
        return got

    def _move(self, state: int, b: int) -> tuple[int, int]:
        left, ended = [], -1
        trie = self.trie
        for node, last in self.states[state]:
            after = trie[node].get(b)
            if after is None:
                continue
            if trie[after]:
                left.append((after, last))
            token = self.token_at[after]
            if token >= 0 and ended < 0 and self.fits(last, token):
                ended = token
        if ended < 0:
            raise ValueError("the vocabulary lacks a byte")
        left.append((0, ended))
        key = tuple(left)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][b] = (to, ended)
        return to, ended

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one match."""
        feed = Feed(self)
        out = feed.push(data) if len(data) > 4096 else []
        if not out and not feed.ends:
            feed.run(data)
        return out + feed.close()


class Feed:
    """One input read by the transducer bit by bit.

    ``ends`` has the last token of each prefix that isn't settled; the tokens of an open position are
    found by walking back over it. What the walks of all open positions share is settled and goes out.
    """

    def __init__(self, transducer: Transducer):
        self.t, self.state, self.ends = transducer, 0, []
        if len(transducer.states) > MAX_STATES:
            transducer.restart()
        if len(transducer.pairs) > MAX_PAIRS:
            transducer.pairs.clear()

    def run(self, data: bytes) -> None:
        moves, state, add = self.t.moves, self.state, self.ends.append
        for b in data:
            step = moves[state].get(b)
            state, token = step if step is not None else self.t._move(state, b)
            add(token)
        self.state = state

    def _back(self, at: int) -> list[int]:
        """The boundaries before and at ``at``, last first."""
        ends, length, out = self.ends, self.t.length, []
        while at > 0:
            out.append(at)
            at -= length[ends[at - 1]]
        return out

    def push(self, data: bytes) -> list[int]:
        """Read on; the tokens that are settled now."""
        out: list[int] = []
        for at in range(0, len(data), 4096):
            self.run(data[at : at + 4096])
            n = len(self.ends)
            open_ = [n - self.t.depth[node] for node, _ in self.t.states[self.state]]
            shared = set(self._back(open_[0]))
            for i in open_[1:]:
                shared &= set(self._back(i))
            if shared:
                upto = max(shared)
                out += [self.ends[i - 1] for i in reversed(self._back(upto))]
                del self.ends[:upto]
        return out

    def close(self) -> list[int]:
        """The tokens that the end of the input settles."""
        out = [self.ends[i - 1] for i in reversed(self._back(len(self.ends)))]
        self.state, self.ends = 0, []
        return out


class Utf8Stream:
    """Text from tokens as they come. A state: how many bytes are still due and the range of the next one."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.number: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.moves: dict[tuple[int, int], tuple[int, str]] = {}

    @staticmethod
    def _step(held: tuple[int, ...], b: int) -> tuple[tuple[int, ...], str]:
        """One byte: what is held of an open code point, and the text that is settled."""
        if held:
            lead = held[0]
            due = 1 + (lead >= 0xE0) + (lead >= 0xF0)
            low, high = 0x80, 0xBF
            if len(held) == 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
            if low <= b <= high:
                held = (*held, b)
                return ((), bytes(held).decode()) if len(held) == due + 1 else (held, "")
            again, text = Utf8Stream._step((), b)
            return again, _REPLACEMENT + text
        if b < 0x80:
            return (), chr(b)
        return ((b,), "") if 0xC2 <= b <= 0xF4 else ((), _REPLACEMENT)

    def feed(self, state: int, token: int) -> tuple[int, str]:
        got = self.moves.get((state, token))
        if got is None:
            held, text = self.states[state], ""
            for b in self.bytes_of[token]:
                held, more = self._step(held, b)
                text += more
            if held not in self.number:
                self.number[held] = len(self.states)
                self.states.append(held)
            got = self.moves[state, token] = (self.number[held], text)
        return got

    def end(self, state: int) -> str:
        return _REPLACEMENT if self.states[state] else ""

    def decode(self, ids) -> str:
        state, out = 0, []
        for i in ids:
            state, text = self.feed(state, i)
            out.append(text)
        return "".join(out) + self.end(state)


class ByteBpe:
    """Texts to ids and back; words met before come from a bounded cache."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL):
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.stream = Utf8Stream(self.transducer.bytes_of)
        self.cache = WordCache(splitter(pattern), self._encode, 2 * CACHED_WORDS)
        top = max(self.ranks.values()) + 1
        self.pieces = [self.transducer.bytes_of.get(i, b"") for i in range(top)]

    def _encode(self, words: list[str]) -> list[bytes]:
        encode = self.transducer.encode
        coded = [encode(w.encode("utf-8", "surrogatepass")) for w in words]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in coded]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = self.cache.words(texts)
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), dtype="<u4") for words in split]
        self.cache.done()
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.stream.decode(ids.tolist())


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str = BYTE_LEVEL) -> ByteBpe:
    """One codec a Python worker and file."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def _mapped(df: DataFrame, schema: str, step) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, max(1, len(pdf)), 1000):
                yield step(pdf.iloc[at : at + 1000])

    return bound_batches(df).mapInPandas(batches, schema)


def encode_column(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", pattern: str = BYTE_LEVEL) -> DataFrame:
    """``df`` with the ids of its text as an array of ints (a column named ``ids`` is replaced)."""
    kept = df.drop(ids) if ids != text else df
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            coded = [x.astype(np.int32) for x in byte_bpe(ranks_path, pattern).encode(texts)]
            yield with_arrays(batch, **{ids: pa.array(coded, pa.list_(pa.int32()))})

    return bound_batches(kept).mapInArrow(task, schema)


def decode_column(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids (null ids: empty text; a column named ``text`` is replaced)."""
    kept = df.drop(text) if ids != text else df
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(ranks_path)
        for batch in it:
            texts = [codec.stream.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield with_arrays(batch, **{text: pa.array(texts, pa.string())})

    return bound_batches(kept).mapInArrow(task, schema)


def round_trip(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids: counts and digests, one row a document.

    ``valid_utf8`` is what the incremental UTF-8 machine says at the end of the ids.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"
    narrow = df.select(id_column(df, key), text_of(text).alias("text"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = byte_bpe(ranks_path)
        n, ids_sha, decoded_sha, valid = [], [], [], []
        for ids in codec.encode(pdf["text"].tolist()):
            listed = ids.tolist()
            n.append(len(listed))
            ids_sha.append(hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest())
            digest, state, ok = hashlib.sha256(), 0, True
            for at in range(0, len(listed), 4096):  # as a stream: what is open at the end of a block goes on in the next
                block = listed[at : at + 4096]
                data = b"".join(map(codec.pieces.__getitem__, block))
                digest.update(data)
                if state or not data.isascii():
                    for i in block:
                        state, text_ = codec.stream.feed(state, i)
                        ok = ok and _REPLACEMENT not in text_
            decoded_sha.append(digest.hexdigest())
            valid.append(ok and state == 0)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "valid_utf8": valid})

    return ids_back(_mapped(narrow, schema, step))
