"""Operators 2, 9 and 10 against the public libraries and by brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausegrid.llm import bpe, packing, registry, token_counts, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  x", "a" * 5000, "<|endoftext|> don't", "Only <|endoftext|> here", "<|endoftext|><|endoftext|>", "ab " * 70_000 + "<|endoftext|>", "中<|endoftext|> <|endoftext |>", "é中文😀\x00\x1c²Ⅷ", "tie", "tie", "l’été  \t\r\n12³"]


@pytest.fixture(scope="module")
def json_tok():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")


def test_pattern_is_the_published_one():
    assert tokens.BYTE_LEVEL == P.PATTERN


def test_split_engines_agree_on_latin1():
    r = random.Random(3)
    slow, fast = __import__("regex").compile(P.PATTERN).findall, tokens.splitter()
    for _ in range(3000):
        t = "".join(chr(r.choice([r.randrange(256), r.randrange(32, 127), 32, 10])) for _ in range(r.randrange(40)))
        assert slow(t) == fast(t)


def test_json_engines_agree(json_tok):
    r = random.Random(7)
    codec = tokens.JsonTokens(JSON)
    texts = ["".join(chr(r.choice([r.randrange(256), r.randrange(32, 127), 32, 10, 39])) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["".join(r.choice("aab 中é😀's\n") for _ in range(r.randrange(60))) for _ in range(1000)] + [t or "" for t in ODD] + ["ab " * 100_000]
    want = json_tok.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [x.ids for x in want]


def test_special_tokens_as_the_library_reads_them():
    plain, r = Tokenizer.from_file(JSON), random.Random(9)
    codec = tokens.JsonTokens(JSON, special=True)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "ab", "é", "中", "\n", "'s", "<|", "12"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)] + ["ab " * 80_000 + "<|endoftext|>"]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want
    assert any(50256 in ids for ids in want) or any(0 in ids for ids in want)


def test_transducer_equals_library():
    codec = bpe.byte_bpe(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("aaabcdehinost  '\n.,!-éß中😀") for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["a" * 9999, " " * 5000, "abcanst" * 2000, *[t for t in ODD if t]]
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == lib.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_transducer_streams_with_bounded_delay():
    t = bpe.byte_bpe(RANKS).transducer
    data = b"streaming" * 4000
    feed, out, held = bpe.Feed(t), [], []
    for at in range(0, len(data), 7):
        out += feed.push(data[at : at + 7])
        held.append(len(feed.ends))
    assert out + feed.close() == t.encode(data) and max(held) < 300


def test_utf8_machine_equals_strict_replacement():
    r = random.Random(2)
    stream = bpe.Utf8Stream({i: bytes([i]) for i in range(256)})
    for _ in range(5000):
        data = bytes(r.choice([r.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 65]) for _ in range(r.randrange(8)))
        assert stream.decode(data) == data.decode("utf-8", "replace")


def test_op10_rows(spark, sf, odd):
    got = {x.doc_id: x for x in bpe.round_trip(odd, RANKS).collect()}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for i, t in enumerate(ODD):
        ids = lib.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].valid_utf8
    coded = bpe.encode_column(odd, RANKS)
    assert coded.columns == ["doc_id", "text", "start", "ids"]
    back = bpe.decode_column(coded.drop("text"), RANKS)
    assert sorted((x.doc_id, x.text) for x in back.collect()) == [(i, t or "") for i, t in enumerate(ODD)]
    assert bpe.round_trip(odd.limit(0), RANKS).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {x.doc_id: x for x in registry.op10_byte_bpe(spark, sf).collect()}
    assert all(rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest() for d in docs) and len(rows) == len(docs)


def check_packed(rows, want, capacity):
    """``want``: ids of each document with its end."""
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        at = 0
        for x in sorted(by_doc[doc], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(ids)
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity and all(x.sequence_tokens == at for x in pieces)
        padded += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return padded / total


def test_op2_rows(spark, sf, odd, json_tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    plain = Tokenizer.from_file(JSON)  # as the contract calls it, without flags
    want = {d.doc_id: [*plain.encode(d.text, add_special_tokens=False).ids, 1] for d in docs}
    assert check_packed(registry.op2_harmonic_packing(spark, sf).collect(), want, 2048) == 0
    want = {i: [*json_tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}
    assert check_packed(packing.pack_documents(odd, JSON, special=False).collect(), want, 2048) == 0
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}
    assert check_packed(packing.pack_documents(odd, JSON).collect(), want, 2048) == 0
    assert check_packed(packing.pack_documents(odd, JSON, capacity=64).collect(), want, 64) == 0
    assert packing.pack_documents(odd.limit(0), JSON).count() == 0


def test_harmonic_classes():
    piece = lambda doc, n: packing.Piece(doc, 0, bytes(range(256))[: 4 * n] if n <= 64 else bytes(4 * n), n)
    bins = packing.HarmonicBins(60)
    assert list(bins.add(piece(1, 25))) == [] and list(bins.open) == [2]  # in (20, 30]: two of them
    assert list(bins.add(piece(2, 13))) == [] and sorted(bins.open) == [2, 4]
    assert list(bins.add(piece(3, 27))) == [] and bins.room == 8 and list(bins.open) == [4]  # 25 + 27 leave room for 8
    (done,) = bins.add(piece(4, 20))  # its first 8 fill it, 12 go on in class 5
    assert [(x.doc, x.start, len(x)) for x in done] == [(1, 0, 25), (3, 0, 27), (4, 0, 8)] and {k: len(x) for k, x in bins.open.items()} == {4: 1, 5: 1}
    assert [(x.doc, x.start, len(x)) for one in bins.add(piece(5, 130)) for x in one] == [(5, 0, 60), (5, 60, 60)]
    rest = list(bins.rest())
    assert [sum(map(len, one)) for one in rest] == [32, 2, 1] and bins.open == {} and bins.room == 0
    r, n, cuts = random.Random(4), 0, 0
    bins, docs = packing.HarmonicBins(2048), [min(6000, int(r.expovariate(1 / 700)) + 1) for _ in range(3000)]
    for doc, size in enumerate(docs):
        for one in bins.add(packing.Piece(doc, 0, bytes(4 * size), size)):
            assert sum(map(len, one)) == 2048
            n, cuts = n + 1, cuts + len(one)
    assert sum(map(len, (x for one in bins.rest() for x in one))) + 2048 * n == sum(docs) and cuts < 2.1 * len(docs)



def brute_counts(ids, end):
    out, n = [], 0
    for i in ids:
        if i == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return [*out, (n, False)] if n else out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan_brute_force(spark, block):
    r = random.Random(block)
    streams = {str(k): [r.choice([9, 1, 2, 3, 0x0900, 0x0109]) for _ in range(r.randrange(1, 60))] for k in range(12)}
    rows = []
    for k, ids in streams.items():
        data = np.array(ids, dtype="<u2").tobytes()
        rows += [(k, j, data[at : at + 2 * block]) for j, at in enumerate(range(0, len(data), 2 * block))]
    blocks = spark.createDataFrame(rows, "stream string, block long, tokens binary")
    got = {}
    for x in token_counts.count_tokens(token_counts.scan_blocks(blocks, end_id=9)).orderBy("stream", "ordinal").collect():
        got.setdefault(x.stream, []).append((x.n_tokens, x.terminated))
    assert got == {k: b for k, ids in streams.items() if (b := brute_counts(ids, 9))}


@pytest.mark.parametrize("width,step", [(2, 7), (4, 1000)])
def test_files_of_any_origin(spark, tmp_path, width, step):
    """Files by byte ranges against their ids; one is empty, one ends without a separator."""
    r = random.Random(width)
    files = {f"part-{k}": [r.choice([9, 1, 2, 0x0900, 300]) for _ in range(r.randrange(1, 400))] for k in range(5)} | {"part-none": [], "part-open": [9, 9, 5]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype=f"<u{width}").tobytes())
    got = {}
    for x in token_counts.count_tokens(token_counts.scan_files(spark, f"file://{tmp_path}", 9, width, step)).orderBy("stream", "ordinal").collect():
        got.setdefault(x.stream, []).append((x.n_tokens, x.terminated))
    assert got == {k: b for k, ids in files.items() if (b := brute_counts(ids, 9))}
    (tmp_path / "part-odd").write_bytes(b"12345")
    with pytest.raises(Exception, match="no multiple"):
        token_counts.scan_files(spark, f"file://{tmp_path}", 9, width, step).collect()


def test_op9_rows(spark, sf, odd, json_tok, tmp_path):
    want = [len(json_tok.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    for ids in (4000, 1 << 18):
        rows = token_counts.document_tokens(odd, f"file://{tmp_path}/{ids}", JSON, range_ids=ids).collect()
        assert sorted((x.doc_id, x.n_tokens) for x in rows) == list(enumerate(want)) and all(x.terminated for x in rows)
    twice = odd.select(F.expr("nullif(doc_id, 3)").alias("doc_id"), "text").where("length(text) < 100 OR text IS NULL")
    rows = token_counts.document_tokens(twice.unionByName(twice), f"file://{tmp_path}/twice", JSON, range_ids=4).collect()
    few = [n for n, t in zip(want, ODD) if t is None or len(t) < 100]
    assert sorted(x.n_tokens for x in rows) == sorted(few * 2) and sum(x.doc_id is None for x in rows) == 2
    assert token_counts.document_tokens(odd.limit(0), f"file://{tmp_path}/none", JSON).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {x.doc_id: x.n_tokens for x in registry.op9_token_counts(spark, sf).collect()} == {d.doc_id: len(json_tok.encode(d.text, add_special_tokens=False).ids) for d in docs}


def test_ids_that_do_not_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string")
    with pytest.raises(ValueError, match="doesn't fit"):
        token_counts.write_token_files(docs, f"file://{tmp_path}/a", P.path("byte_bpe_50k.json"), end_id=70_000)
    with pytest.raises(Exception, match="doesn't fit in 1 bytes"):
        token_counts.write_token_files(docs, f"file://{tmp_path}/b", P.path("byte_bpe_50k.json"), end_id=5, width=1).collect()
