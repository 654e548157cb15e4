"""Operators 5 and 8 by brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from clausegrid.llm import fingerprints, registry, shingles, substrings


def brute_shingles(text, k, lower=False):
    data = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", data.lower() if lower else data)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def some_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(["ab ", "Ab ", "c", "é ", " x\x0b", "\n", "zz zz ", "\xa0", "QQ "]) for _ in range(r.randrange(25))) for _ in range(n)] + ["", " ", "a", "a b", "b a", "A B"]


@pytest.mark.parametrize("lower", [False, True])
def test_shingle_hashes_are_one_to_one(lower):
    texts = some_texts(1, 400)
    hashes, counts = shingles.shingle_hashes([t.encode() for t in texts], 4, lower)
    of, at = {}, 0
    for t, n in zip(texts, counts):
        want, got = brute_shingles(t, 4, lower), set(hashes[at : at + n].tolist())
        assert len(want) == len(got)
        of.setdefault(frozenset(want), got)
        assert of[frozenset(want)] == got
        at += n
    every = set().union(*(brute_shingles(t, 4, lower) for t in texts))
    assert len(every) == len(set(hashes.tolist()))


def test_signature_estimates_jaccard():
    a, b = [f"w{i}" for i in range(2000)], [f"w{i}" for i in range(500, 2500)]
    sig = fingerprints.signatures([" ".join(a).encode(), " ".join(b).encode()], 5, shingles.MinHash(1024, 3))
    assert abs((sig[0] == sig[1]).mean() - 1496 / 2496) < 0.06


def test_parts_share_shingles():
    texts = some_texts(2, 500)
    for t, n in zip(texts, texts[1:]):
        e = fingerprints.edit(t, n)
        head, own, other = (x.decode("utf-8", "replace") for x in fingerprints._parts(t, e, 5))
        shared = brute_shingles(head, 5) if head else set()
        assert shared | brute_shingles(own, 5) == brute_shingles(t, 5)
        assert shared | brute_shingles(other, 5) == brute_shingles(e, 5)


def check_fingerprints(docs, rows, n_hashes=128):
    """``docs``: (id, text) with distinct (id, text) unless equal."""
    order = sorted(((-(1 << 63) if i is None else i, (t or "").encode()) for i, t in docs))
    hashes = shingles.MinHash(n_hashes, 8)
    want = []
    for j, (i, data) in enumerate(order):
        text, after = data.decode(), order[(j + 1) % len(order)][1].decode()
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        sig = fingerprints.signatures([text.encode(), edited.encode(), after.encode()], 5, hashes)
        hexed = [s.astype(">u4").tobytes().hex() for s in sig]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed[0], hexed[1], (sig[0] == sig[1]).mean(), (sig[0] == sig[2]).mean()))
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)
    assert got == sorted(want)


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_brute_force(spark, parts):
    texts = some_texts(parts, 150)
    docs = [((i * 37) % 1000, t) for i, t in enumerate(texts)] + [(None, None), (2000, None), (2001, "x y " * 4000), (5, "tie"), (5, "tie"), (5, "another")]
    df = spark.createDataFrame([(i, t, "f") for i, t in docs], "doc_id long, text string, fingerprint string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check_fingerprints(docs, fingerprints.fingerprint_edits(df).collect())
        one = fingerprints.fingerprint_edits(df.where("doc_id = 2001")).collect()
        check_fingerprints([docs[-4]], one)
        assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_near_groups(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:59], "x"]), " ".join(base[30:] + base[:30]), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fingerprints.near_groups(df).collect()}
    assert got == {0: (56, 0), 1: (56, 0), 2: (56, 0), 3: (0, 3)}


def test_op8_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = registry.op8_minhash_fingerprints(spark, sf).collect()
    check_fingerprints(docs, rows)
    assert np.mean([r.near_edited for r in rows]) > 0.4 and np.median([r.near_next for r in rows]) < 0.1


@pytest.mark.parametrize("unit", list(substrings.UNITS))
def test_units_are_the_text(unit):
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice("ab .!?\n\t\r1 é") for _ in range(r.randrange(30)))
        assert "".join(substrings.UNITS[unit].findall(t)) == t
    assert "".join(substrings.UNITS[unit].findall("a" * 200_000)) == "a" * 200_000


def test_sentences():
    assert substrings.UNITS["sentence"].findall("A b. C d! e 1.5 f... g?\nh.\n\ni j") == ["A b. ", "C d! ", "e 1.5 f... ", "g?\n", "h.\n", "\n", "i j"]


def ranked(docs):
    return sorted(set(docs), key=lambda x: (-1 if x[0] is None else x[0]))


def rebuilt(units, gone):
    spans, at = [], 0
    for i, u in enumerate(units):
        spans += range(at, at + len(u)) if i in gone else ()
        at += len(u)
    return "".join(u for i, u in enumerate(units) if i not in gone), spans


def brute_dedup(docs, unit):
    """Every unit that isn't blank and was seen before goes."""
    seen, out = set(), {}
    for i, t in ranked(docs):
        units, gone = substrings.UNITS[unit].findall(t or ""), set()
        for j, u in enumerate(units):
            name = tuple(u.lower().split())
            if name and name in seen:
                gone.add(j)
            seen.add(name)
        out[i, t] = (None, []) if t is None else rebuilt(units, gone)
    return out


def brute_passages(docs, run):
    """Lines seen before, and runs of ``run`` words of sentences (short ones with their neighbours) seen before."""
    seen, out = set(), {}
    for i, t in ranked(docs):
        units = substrings.UNITS["sentence"].findall(t or "")
        n = [substrings.size(u) for u in units]
        held = {}  # first and last unit with words: (kind, units from, to)
        for j, k in enumerate(n):
            if 0 < k < 5:
                b = next((b for b in range(j, len(n)) if sum(n[j : b + 1]) >= 5), None)
                a = next((a for a in range(j, -1, -1) if sum(n[a : j + 1]) >= 5), None)
                held |= {(j, b): ("span", j, b)} if b is not None else {}
                held |= {(a, j): ("span", a, j)} if a is not None else {}
            elif k >= 5:
                held[j, j] = ("sentence", j, j)
        begin = 0
        for j, u in enumerate(units):
            if u.endswith("\n") or j + 1 == len(units):
                words = [x for x in range(begin, j + 1) if n[x]]
                if words:
                    held[words[0], words[-1]] = ("line", begin, j)
                begin = j + 1
        gone, repeated, ends = set(), set(), {}
        for key in sorted(held):
            kind, a, b = held[key]
            name = tuple("".join(units[a : b + 1]).lower().split())
            if kind == "span" and ends.get(name, -1) >= a:
                continue
            if kind == "span":
                ends[name] = b
            if name in seen:
                repeated.update(range(a, b + 1))
                gone.update(range(a, b + 1) if kind == "line" else ())
            seen.add(name)
        runs, new = [[]], 0
        for j in range(len(units)):
            new = 0 if j in repeated else new + n[j]
            if new >= 5:
                runs.append([])
            elif j in repeated:
                runs[-1].append(j)
        for one in runs:
            gone.update(one if sum(n[j] for j in one) >= run else ())
        out[i, t] = (None, []) if t is None else rebuilt(units, gone)
    return out


def hostile_docs(seed):
    r = random.Random(seed)
    pool = ["One two three four.", "one  TWO three four.", "Alpha beta gamma! ", "x", "", "Unique", "a b c d e f\n\n", "hot line of all documents."]
    docs = [(i, "".join(r.choice(pool) + r.choice([" ", "\n", ""]) for _ in range(r.randrange(9)))) for i in range(80)]
    return docs + [(100, None), (101, ""), (102, "One two three four. " * 300), (7, docs[7][1]), (None, "nothing like it in here"), (103, "\n \n\n")]


@pytest.mark.parametrize("unit,passages", [("line", 0), ("sentence", 0), ("paragraph", 0), ("line", 9), ("line", 20)])
def test_dedup_brute_force(spark, unit, passages):
    docs = hostile_docs(len(unit) + passages)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, at int, k string")
    got = substrings.dedup_units(df, unit, passages)
    assert got.columns == ["doc_id", "text", "at", "k", "removed"]
    rows = got.collect()
    assert len(rows) == len(docs)
    want = brute_passages(docs, passages) if passages else brute_dedup(docs, unit)
    original = {}
    for i, t in docs:
        original.setdefault(i, t)
    for x in rows:
        text, gone = want[x.doc_id, original[x.doc_id]]
        assert x.text == text and [c for s in x.removed for c in range(s.start, s.end)] == list(gone)
    assert substrings.dedup_units(df.limit(0), unit, passages).count() == 0


def test_op5_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_dedup(docs, "line")
    rows = registry.op5_unit_dedup(spark, sf).collect()
    assert len(rows) == len(docs)
    for x in rows:
        stretches = [tuple(map(int, s.split("-"))) for s in x.removed_spans.split(",") if s]
        text, gone = want[x.doc_id, dict(docs)[x.doc_id]]
        assert x.text == text and x.removed_chars == len(gone) and [c for a, b in stretches for c in range(a, b)] == list(gone)


def test_whole_lines_go(spark):
    line = "the and attion to thanedble here.\n"  # 6 words: no run of 20
    texts = [
        f"{line}Only this document has these words.\n",
        f"Another document begins with this text.\n{line}And it ends with other words again.\n",
        "A b c d e f. Then this line goes on with words of its own.",
        "A b c d e f. But here it goes on with quite other words.",
        "One two.\nThree four five.\n\nA text that is new.",
        "What comes before is new here.\n\nOne two.\nThree four five.\n",
        "Red blue green. Up down. \n",
        "Again something that is new here. Red up.\nred  blue GREEN. Up down.",
        "Yes.\nThe sun is up.\n",
        "yes.\nThe moon is up.\nYES.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup_units(df, passages=20).collect()}
    want = [*texts[:1], texts[1].replace(line, ""), *texts[2:5], "What comes before is new here.\n\n", texts[6], "Again something that is new here. Red up.\n", texts[8], "The moon is up.\n"]
    assert [got[i].text for i in range(10)] == want
    plain = {r.doc_id: r.text for r in substrings.dedup_units(df).collect()}
    assert [plain[i] for i in range(10)] == want
    assert [(s.start, s.end) for s in got[1].removed] == [(40, 40 + len(line))]


def test_op5_query_takes_repeated_lines_out(spark, sf):
    seen = set()
    for r in sorted(registry.op5_unit_dedup(spark, sf).collect(), key=lambda r: r.doc_id):
        for line in (r.text or "").split("\n"):
            words = line.lower().split()
            assert not words or tuple(words) not in seen
            seen.add(tuple(words))


def test_passages_of_short_units_go(spark):
    verse = "Rain falls. The wind. Cold night! Go home. Sit down. Light it. Warm hands. Old songs. Sleep now. All quiet. Snow."
    chinese = "天气很好。我们今天去公园散步。孩子们在湖边玩水。老人坐在树下聊天喝茶。晚上大家一起回家吃饭看电视。"
    menu = "Fish soup\nRed beans\nRice\nGreen tea\nWhite bread\nBlack coffee\nApple pie\nOld cheese\nFried eggs\nCold milk\nMint\nSalt\n"
    few = "Yes. No. Of course. Well."
    texts = [
        f"Here is the first of the texts. {verse} That was all of it for today.\n{menu}{few} And then goes on with other things.",
        f"A second text that is its own. {verse} After it come some other words here.\n",
        f"Soups and other dishes of the house:\n{menu}Prices are on the other page.\n",
        f"The third says nothing of the kind. {few} It answers in short and stays whole.",
        "开头的句子是新的没有人写过。" + chinese,
        "这里是另外一篇文章的新开头。" + chinese + "最后一句话也是新的没有出现过。",
        "Yes. " * 40,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.dedup_units(df, passages=20).collect()}
    assert got[0] == texts[0] and got[3] == texts[3] and got[4] == texts[4]
    assert got[1] == texts[1].replace(verse + " ", "")
    assert got[2] == texts[2].replace(menu, "")
    assert got[5] == texts[5].replace(chinese, "")
    assert got[6] == "Yes. " * 5


def test_size_counts_characters_too():
    assert [substrings.size(x) for x in ("", " \n", "a b c", "x" * 60, "中文字符语言中文字符")] == [0, 0, 3, 5, 5]
    assert substrings.UNITS["sentence"].findall("你好。「再见！」走吧") == ["你好。", "「再见！」", "走吧"]
