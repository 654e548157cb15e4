"""Many terms and patterns in one pass over the text: an Aho-Corasick automaton in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters that the terms of an automaton have together; it is built in every task.
MOST_CHARACTERS = 10_000_000


class Terms:
    """Finds terms in texts; each is looked for once, however many rules name it."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.machine.add_word(t, i)
        if terms:
            self.machine.make_automaton()

    def first_places(self, text: str) -> dict[int, int]:
        """Where each term that is in ``text`` begins first."""
        found: dict[int, int] = {}
        if self.terms:
            for end, i in self.machine.iter(text):
                if i not in found:
                    found[i] = end + 1 - len(self.terms[i])
        return found


def _checked(spark: SparkSession, value: object, characters: int):
    if characters > MOST_CHARACTERS:
        raise ValueError(f"a catalogue has {MOST_CHARACTERS} characters at most")
    return spark.sparkContext.broadcast(value)


def term_scan(spark: SparkSession, terms: list[str]) -> Callable[..., Column]:
    """A function of a text column: (ord, term) of each of ``terms`` in it, in their order, as an array; null for null."""
    shared = _checked(spark, terms, sum(map(len, terms)))
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("term", pa.string())]))

    @F.arrow_udf("array<struct<ord:int,term:string>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        every = shared.value
        places: dict[str, list[int]] = {}
        for i, t in enumerate(every):
            places.setdefault(t, []).append(i)
        machine = Terms(list(places))
        for texts in batches:
            found = [None if t is None else sorted(i for k in machine.first_places(t) for i in places[machine.terms[k]]) for t in texts.to_pylist()]
            yield pa.array([None if some is None else [(i, every[i]) for i in some] for some in found], kind)

    return scan


def rule_scan(spark: SparkSession, rules: list[tuple[int, str, list[str] | str, list[str]]]) -> Callable[..., Column]:
    """A function of text and clause type: (rule_ord, quote, reason) of each rule that hits, by rule, as an array.

    ``rules``: (number, KEYWORD or REGEX, terms or pattern, clause types or none for all). A keyword rule quotes its leftmost term (the
    earlier in its list at the same place) and names all that are there; a pattern its first match, unless that is empty.
    """
    shared = _checked(spark, rules, sum(len(x) if isinstance(x, str) else sum(map(len, x)) for _, _, x, _ in rules))
    kind = pa.list_(pa.struct([("rule_ord", pa.int32()), ("quote", pa.string()), ("reason", pa.string())]))

    @F.arrow_udf("array<struct<rule_ord:int,quote:string,reason:string>>")
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scope = {n: frozenset(s) for n, _, _, s in shared.value}
        uses: dict[str, list[tuple[int, int]]] = {}  # the rule table: of each term the rules and its rank in them
        for n, kind_of, words, _ in shared.value:
            if kind_of == "KEYWORD":
                for rank, w in enumerate(dict.fromkeys(words)):
                    uses.setdefault(w, []).append((n, rank))
        patterns = [(n, re.compile(p)) for n, kind_of, p, _ in shared.value if kind_of == "REGEX"]
        machine = Terms(list(uses))

        def hits(text: str, clause_type: str | None) -> list[tuple[int, str, str]]:
            by_rule: dict[int, list[tuple[int, int, str]]] = {}
            for i, at in machine.first_places(text).items():
                for n, rank in uses[machine.terms[i]]:
                    if not scope[n] or clause_type in scope[n]:
                        by_rule.setdefault(n, []).append((at, rank, machine.terms[i]))
            out = []
            for n, some in by_rule.items():
                names = [w for _, _, w in sorted(some)]
                out.append((n, names[0], "命中规则关键词：" + "、".join(f"「{w}」" for w in names)))
            for n, pattern in patterns:
                if (not scope[n] or clause_type in scope[n]) and (m := pattern.search(text)) and m.group():
                    out.append((n, m.group(), f"命中规则正则（{pattern.pattern}）：「{m.group()}」"))
            return sorted(out)

        for texts, types in batches:
            yield pa.array([[] if t is None else hits(t, c) for t, c in zip(texts.to_pylist(), types.to_pylist())], kind)

    return scan
