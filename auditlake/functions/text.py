"""SQL text for string work: literals, regex dialect, lines and neighbourhoods.

Expressions are built as SQL text because one parsed string holds a whole rule group; the
same text is used inside higher-order functions, where it is evaluated on the JVM.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser as sre_parse

# Unicode white space as Python's str.strip sees it
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_BREAKS = list("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
# characters that match an ASCII letter case-insensitively although lower() does not map them to it
ODD_CASE = list("\u017f\u212a\u0130\u0131")


def lit(text: str) -> str:
    """Spark SQL string literal."""
    out = []
    for ch in text:
        if ch in "\\'":
            out.append("\\" + ch)
        elif " " <= ch <= "~" and ch != "$":  # "${name}" in SQL text would be substituted
            out.append(ch)
        else:
            out.append("".join(f"\\u{unit:04x}" for unit in _utf16(ch)))
    return "'" + "".join(out) + "'"


def _utf16(ch: str) -> list[int]:
    raw = ch.encode("utf-16-be")
    return [int.from_bytes(raw[i:i + 2], "big") for i in range(0, len(raw), 2)]


def java(pattern: str, flags: str = "i") -> str:
    """A Python ``re`` pattern in the JVM dialect: Unicode classes, only newline ends a line."""
    return f"(?{flags}dU)" + pattern.replace("(?P<", "(?<")


def rlike(expr: str, pattern: str, flags: str = "i") -> str:
    return f"({expr} RLIKE {lit(java(pattern, flags))})"


def any_rlike(expr: str, patterns: list[str], flags: str = "i") -> str:
    return "(" + " OR ".join(rlike(expr, p, flags) for p in patterns) + ")"


def has_any(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in dict.fromkeys(needles)) + ")"


def count_any(expr: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"int(contains({expr}, {lit(n)}))" for n in needles) + ")"


def one_of(expr: str, values: list[str]) -> str:
    return f"({expr} IN ({', '.join(lit(v) for v in values)}))"


def strip(expr: str) -> str:
    return f"trim(BOTH {lit(WHITESPACE)} FROM {expr})"


def strip_chars(expr: str, chars: str) -> str:
    return f"trim(BOTH {lit(chars)} FROM {expr})"


def snippet(expr: str, width: int = 200) -> str:
    return f"substring({strip(expr)}, 1, {width})"


def starts_with_any(expr: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"startswith({expr}, {lit(p)})" for p in prefixes) + ")"


def ends_with_any(expr: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"endswith({expr}, {lit(s)})" for s in suffixes) + ")"


def split_lines(expr: str) -> str:
    """Python ``splitlines``: a final line break does not open another line.

    Rare line breaks become newlines first, so that the split itself is on one plain character.
    """
    text = f"CASE WHEN {has_any(expr, OTHER_BREAKS)} THEN regexp_replace({expr}, {lit(LINE_BREAK)}, '\\n') ELSE {expr} END"
    parts = f"split({text}, '\\n', -1)"
    # the part behind a final newline is no line
    lines = let("parts", parts, "IF(element_at(parts, -1) = '', slice(parts, 1, size(parts) - 1), parts)")
    return f"CASE WHEN {expr} = '' THEN cast(array() AS array<string>) ELSE {lines} END"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, so that the value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def near(no: str, before: int, after: int, lines: str = "lines") -> str:
    """Lines ``no - before`` to ``no + after`` joined by newlines, clipped to the file."""
    first = f"greatest({no} - {before}, 1)"
    return f"array_join(slice({lines}, {first}, {no} + {after} - {first} + 1), '\\n')"


def match_lines(content: str, pattern: str, flags: str = "i") -> str:
    """Every match with the 1-based line it starts on, as array<struct<match, line_no>>.

    A mark is put before each match and the marked text is cut at newlines, so the line of the
    k-th mark is the line of the k-th match; one linear pass, no per-match prefix scan.
    """
    regex = lit(java(pattern, flags))
    clean = f"translate({content}, '\\u0001', '\\u0002')"
    marked = f"split(regexp_replace({clean}, {regex}, '\\u0001$0'), '\\n', -1)"
    numbers = (
        f"flatten(transform({marked}, (l, i) -> "
        f"array_repeat(i + 1, length(l) - length(replace(l, '\\u0001', '')))))"
    )
    return (
        f"transform(arrays_zip(regexp_extract_all({clean}, {regex}, 0), {numbers}), "
        f"z -> named_struct('match', z['0'], 'line_no', z['1']))"
    )


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case strings of which every match must contain at least one; None if unknown."""
    found = _required(sre_parse.parse(pattern, re.IGNORECASE))
    return found if found and all(f.isascii() for f in found) else None


def _required(items) -> set[str] | None:
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and "" not in found:
            if best is None or min(map(len, found)) > min(map(len, best)):
                best = found

    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        offer({run})
        run = ""
        if op is sre.SUBPATTERN:
            offer(_required(arg[3]))
        elif op is sre.BRANCH:
            sides = [_required(side) for side in arg[1]]
            if all(sides):
                offer(set().union(*sides))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            offer(_required(arg[2]))
    offer({run})
    return best


def stems(patterns: list[str]) -> list[str] | None:
    """Union of the required literals of several patterns; None if one has none."""
    every: set[str] = set()
    for pattern in patterns:
        found = required_literals(pattern)
        if found is None:
            return None
        every |= found
    # a stem that contains another stem adds nothing
    return sorted(s for s in every if not any(o != s and o in s for o in every))


PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def required_marks(pattern: str) -> list[list[str]]:
    """Sets of ASCII punctuation; every match holds a character of each set."""
    found = dict.fromkeys(_marks(sre_parse.parse(pattern, re.IGNORECASE)))
    # a set that holds another set adds nothing
    return [sorted(s) for s in found if not any(o < s for o in found)]


def _marks(items) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    for op, arg in items:
        if op is sre.LITERAL:
            chars = {chr(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            chars = {chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            found += _marks(arg[3])
            continue
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            found += _marks(arg[2])
            continue
        else:
            continue
        if chars <= PUNCTUATION:
            found.append(frozenset(chars))
    return found
