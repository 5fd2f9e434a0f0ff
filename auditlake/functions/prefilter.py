"""Which literals a file holds, found for all rules in one pass over its text.

Rules ask by ``mark`` whether a lower-cased text holds one of several literals; the answer is a token in their SQL text.
``resolved`` looks at all SQL texts of a scan together: if they ask for few literals, tokens become substring tests; if they ask for
many, one Aho-Corasick automaton finds them all, a function over Arrow arrays gives the answers of a file as bits, and
tokens become tests of a bit. The cost of a file then grows with its length, not with the number of rules.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import has_any

TOKEN = re.compile(r"\bliterals_(\d+)\b")
#: bits in a word of the answer; the sign is left alone
WORD = 63
#: from so many literals on the automaton is used
MANY = 48
_groups: list[tuple[str, ...]] = []
_numbers: dict[tuple[str, ...], int] = {}


def mark(literals: list[str]) -> str:
    """Token for: the lower-cased text holds one of the literals."""
    group = tuple(sorted(dict.fromkeys(literals)))
    if group not in _numbers:
        _numbers[group] = len(_groups)
        _groups.append(group)
    return f"literals_{_numbers[group]}"


def plain(sql: str, text: str = "lc") -> str:
    """Tokens as substring tests on the column ``text``."""
    return TOKEN.sub(lambda m: has_any(text, list(_groups[int(m[1])])), sql)


@lru_cache(maxsize=8)
def automaton(groups: tuple[tuple[str, ...], ...]) -> tuple[ahocorasick.Automaton, list[int]]:
    """The automaton of all literals, and for each literal the bits of the groups that have it."""
    bits: dict[str, int] = {}
    for number, group in enumerate(groups):
        for literal in group:
            bits[literal] = bits.get(literal, 0) | 1 << number
    found = ahocorasick.Automaton()
    for at, literal in enumerate(bits):
        found.add_word(literal, at)
    found.make_automaton()
    return found, list(bits.values())


def words_of(groups: tuple[tuple[str, ...], ...], text: str | None) -> list[int]:
    """The answers for one text, ``WORD`` bits in each word."""
    machine, bits = automaton(groups)
    answer = 0
    for at in {at for _, at in machine.iter(text)} if text else ():
        answer |= bits[at]
    return [answer >> WORD * k & (1 << WORD) - 1 for k in range(-(-len(groups) // WORD))]


def answers_of(groups: tuple[tuple[str, ...], ...], texts: pa.Array) -> pa.Array:
    """Structs of words w0, w1, ... Texts become Python strings one at a time: a batch of long texts is never held in both forms."""
    width = -(-len(groups) // WORD)
    rows = np.array([words_of(groups, t.as_py()) for t in texts], np.int64).reshape(-1, width)
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(width)], [f"w{k}" for k in range(width)])


def finder(groups: tuple[tuple[str, ...], ...], text: Column) -> Column:
    """Struct of words w0, w1, ... for a column of lower-cased texts."""
    @F.arrow_udf(", ".join(f"w{k} BIGINT" for k in range(-(-len(groups) // WORD))))
    def found(texts: pa.Array) -> pa.Array:
        return answers_of(groups, texts)

    return found(text)


class Answers:
    """Tokens of several SQL texts, resolved in one way for all of them."""

    def __init__(self, texts: list[str], many: int = MANY):
        numbers = sorted({int(n) for sql in texts for n in TOKEN.findall(sql)})
        self.groups = tuple(_groups[n] for n in numbers)
        self.bit = {n: at for at, n in enumerate(numbers)}
        self.automatic = len({x for g in self.groups for x in g}) > many

    def column(self, text: Column) -> Column:
        return finder(self.groups, text)

    def sql(self, text: str) -> str:
        if not self.automatic:
            return plain(text)
        return TOKEN.sub(lambda m: f"(({self.place(int(m[1]))}) != 0L)", text)

    def place(self, number: int) -> str:
        word, bit = divmod(self.bit[number], WORD)
        return f"literals_found.w{word} & {1 << bit}L"

    def any_of(self, tokens: set[int]) -> str:
        """Whether one of the tokens holds: one test a word."""
        if not self.automatic:
            return "(" + " OR ".join(plain(f"literals_{n}") for n in sorted(tokens)) + ")"
        masks: dict[int, int] = {}
        for n in tokens:
            word, bit = divmod(self.bit[n], WORD)
            masks[word] = masks.get(word, 0) | 1 << bit
        return "(" + " OR ".join(f"(literals_found.w{w} & {m}L) != 0L" for w, m in sorted(masks.items())) + ")"
