"""Rule scans over files: one narrow pass, no shuffle, no rule x line join.

A file row carries its lines as an array. Each rule group first finds its candidate line numbers
(cheap literal test on the file, then the joined rules and the line gates) and only then looks at
single rules, so rules are matched against the few candidate lines and neighbourhoods are slices
of the array next to them. Which literals a file holds is found for all rules at once (``functions.prefilter``),
and lines are cut only for files in which some line rule can match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import gates as G
from ..functions.prefilter import TOKEN, Answers, mark
from ..functions.text import ODD_CASE, any_rlike, has_any, java, lit, required_marks, rlike, snippet, split_lines, stems

LINE = "lines[no - 1]"
HIT_LINE = "lines[h.no - 1]"


def marked(text: str, needles: list[str]) -> str:
    """``has_any`` that leaves tests of the whole lower-cased content to the prefilter."""
    return mark(needles) if text == "lc" else has_any(text, needles)


#: per-file values every detector shares, computed once; the second group needs the first
FILE_COLUMNS = {
    "rooted": "concat('/', path)",
    "lname": "lower(name)",
    "lc": "lower(content)",
    "odd_case": has_any("content", ODD_CASE),
}
GATE_COLUMNS = {
    "detector_code": G.is_detector_code(found=marked),
    "pattern_context": G.pattern_context(found=marked),
    "test_file": G.test_file(found=marked),
}
LINE_COLUMNS = {
    "lines": f"CASE WHEN lines_needed THEN {split_lines('content')} END",
    "llines": f"CASE WHEN lines_needed THEN {split_lines('lc')} END",
}


def metadata(pairs: dict[str, str]) -> str:
    """Map literal from key to SQL text; values are strings."""
    if not pairs:
        return "cast(map() AS map<string,string>)"
    return "map(" + ", ".join(f"{lit(k)}, cast({v} AS string)" for k, v in pairs.items()) + ")"


def hit(detector: str, kind: str, line: str, text: str, severity: str, confidence: str, meta: str,
        tool_confidence: str | None = None) -> str:
    return (
        f"named_struct('detector', {lit(detector)}, 'type', {lit(kind)}, 'line', cast({line} AS int), "
        f"'snippet', {text}, 'severity', {severity}, 'confidence', cast({confidence} AS double), "
        f"'tool_confidence', cast({tool_confidence or 'NULL'} AS double), 'metadata', {meta})"
    )


def ordered(h: str, row: str) -> str:
    return f"named_struct('rule', {h}.rule, 'ordinal', {h}.ordinal, 'no', {h}.no, 'hit', {row})"


def guard(patterns: list[str]) -> str:
    """Necessary condition on the whole file, from literals the patterns cannot match without."""
    found = stems(patterns)
    if found is None:
        return "true"
    return f"(odd_case OR {has_any('lc', found)})"


def candidate(patterns: list[str]) -> str:
    """``guard`` for the prefilter."""
    found = stems(patterns)
    return "true" if found is None else f"(odd_case OR {mark(found)})"


def line_guard(patterns: list[str]) -> str:
    """The same condition on one line; plain substring tests go before any regex."""
    found = stems(patterns)
    if found is None:
        return "true"
    return f"(odd_case OR {has_any('llines[no - 1]', found)})"


def mark_guard(pattern: str) -> str:
    """Necessary condition of one pattern on a line: the punctuation it cannot match without, in whatever case."""
    tests = [has_any(LINE, marks) for marks in required_marks(pattern)]
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def line_match(patterns: list[str]) -> str:
    """Whether a line matches one of the patterns, each looked at only in lines with the punctuation it needs.

    Patterns without regard to case are tried at every character of a line; few lines of prose have, say, ``=`` and a quote.
    """
    groups: dict[str, list[str]] = {}
    for p in dict.fromkeys(patterns):
        groups.setdefault(mark_guard(p), []).append(p)
    tests = (any_rlike(LINE, g) if any("\\1" in p for p in g) else rlike(LINE, "|".join(f"(?:{p})" for p in g)) for g in groups.values())
    return "(" + " OR ".join(f"({need} AND {test})" for need, test in zip(groups, tests)) + ")"


@dataclass(frozen=True)
class LineRules:
    """Rules matched line by line.

    ``per`` says what yields one row: every (file, rule) with its first accepted line, every
    accepted ``line``, or the first accepted line of the ``file``.
    """

    detector: str
    rules: list[tuple[str, str]]
    files: str
    type: str
    severity: str
    confidence: str
    lines: str = "true"
    accept: Callable[[str, str], str] | None = None
    tool_confidence: str | None = None
    label: str | None = "issue"
    meta: dict[str, str] = field(default_factory=dict)
    per: str = "rule"
    text: str = snippet(HIT_LINE)

    def candidates(self) -> str:
        patterns = [p for p, _ in self.rules]
        if self.accept and self.per != "rule":
            match = "(" + " OR ".join(f"({mark_guard(p)} AND {self._accepts(p)})" for p in patterns) + ")"
        else:
            match = line_match(patterns)
        return (
            f"CASE WHEN {self.files} AND {candidate(patterns)} "
            f"THEN filter(nos, no -> {line_guard(patterns)} AND {match} AND {self.lines}) END"
        )

    def _accepts(self, pattern: str) -> str:
        test = rlike(LINE, pattern)
        return f"({test} AND {self.accept(LINE, pattern)})" if self.accept else test

    def hits(self, cand: str) -> str:
        if self.per == "rule":
            firsts = ", ".join(
                f"named_struct('rule', {k}, 'no', get(filter({cand}, no -> {self._accepts(p)}), 0))"
                for k, (p, _) in enumerate(self.rules)
            )
            found = f"filter(array({firsts}), h -> h.no IS NOT NULL)"
        else:
            chain = "0" if len(self.rules) == 1 else "CASE " + " ".join(
                f"WHEN {self._accepts(p)} THEN {k}" for k, (p, _) in enumerate(self.rules)) + " END"
            found = f"transform({cand}, no -> named_struct('rule', {chain}, 'no', no))"
            if self.per == "file":
                found = f"slice({found}, 1, 1)"
        return f"CASE WHEN size({cand}) > 0 THEN transform({found}, h -> {self.row()}) END"

    def row(self) -> str:
        """The row of a match, over h.rule and h.no."""
        meta = dict(self.meta)
        if self.label:
            labels = "array(" + ", ".join(lit(d) for _, d in self.rules) + ")"
            meta = {self.label: f"{labels}[h.rule]", **meta}
        return hit(self.detector, self.type, "h.no", self.text, self.severity, self.confidence,
                   metadata(meta), self.tool_confidence)

    def every(self, cand: str) -> str:
        """All accepted lines of each rule, in order: array of (rule, ordinal, no, hit)."""
        each = ", ".join(
            f"transform(filter({cand}, no -> {self._accepts(p)}), (no, i) -> named_struct('rule', {k}, 'ordinal', i, 'no', no))"
            for k, (p, _) in enumerate(self.rules))
        return f"CASE WHEN size({cand}) > 0 THEN transform(flatten(array({each})), h -> {ordered('h', self.row())}) END"


@dataclass(frozen=True)
class LineValues:
    """Rules with one capture; each (line, rule) yields its first accepted value."""

    detector: str
    patterns: list[str]
    files: str
    lines: str
    accept: str  # over v
    row: str  # over h.no and h.value

    def candidates(self) -> str:
        match = line_match(self.patterns)
        return (
            f"CASE WHEN {self.files} AND {candidate(self.patterns)} "
            f"THEN filter(nos, no -> {line_guard(self.patterns)} AND {match} AND {self.lines}) END"
        )

    def hits(self, cand: str) -> str:
        found = ", ".join(f"regexp_extract_all({LINE}, {lit(java(p))}, 1)" for p in self.patterns)
        firsts = (
            f"transform(array({found}), (vs, k) -> "
            f"named_struct('rule', k, 'no', no, 'value', get(filter(vs, v -> {self.accept}), 0)))"
        )
        return (
            f"CASE WHEN size({cand}) > 0 THEN transform(flatten(transform({cand}, no -> "
            f"filter({firsts}, h -> h.value IS NOT NULL))), h -> {self.row}) END"
        )

    def every(self, cand: str) -> str:
        """All accepted values of each line and rule, in order: array of (rule, ordinal, no, hit)."""
        found = ", ".join(f"regexp_extract_all({LINE}, {lit(java(p))}, 1)" for p in self.patterns)
        values = (
            f"flatten(transform(array({found}), (vs, k) -> transform(filter(vs, v -> {self.accept}), "
            f"(v, i) -> named_struct('rule', k, 'ordinal', i, 'no', no, 'value', v))))"
        )
        return f"CASE WHEN size({cand}) > 0 THEN transform(flatten(transform({cand}, no -> {values})), h -> {ordered('h', self.row)}) END"


@dataclass(frozen=True)
class FileRule:
    """At most one row per file: ``test`` over the file's columns."""

    files: str
    test: str
    row: str
    patterns: tuple[str, ...] = ()

    def candidates(self) -> None:
        return None

    def hits(self, _: str) -> str:
        need = f" AND {candidate(list(self.patterns))}" if self.patterns else ""
        # a condition of its own: Spark computes what two rules have in common before it looks at any condition joined by AND
        return f"CASE WHEN {self.files}{need} THEN CASE WHEN {self.test} THEN array({self.row}) END END"


@dataclass(frozen=True)
class FileMatches:
    """Every match in the file: ``found`` yields an array, ``row`` maps its element ``m``."""

    files: str
    found: str
    row: str
    patterns: tuple[str, ...]

    def candidates(self) -> None:
        return None

    def hits(self, _: str) -> str:
        return f"CASE WHEN {self.files} AND {candidate(list(self.patterns))} THEN transform({self.found}, m -> {self.row}) END"


Piece = LineRules | LineValues | FileRule | FileMatches


def lines_needed(pieces: list[Piece], answers: Answers) -> str:
    """Whether a rule over lines can match: one test of literals for the pieces of the same files."""
    by_files: dict[str, set[int] | None] = {}
    for piece in pieces:
        if not isinstance(piece, (LineRules, LineValues)):
            continue
        patterns = [p for p, _ in piece.rules] if isinstance(piece, LineRules) else piece.patterns
        tokens = {int(n) for n in TOKEN.findall(candidate(patterns))}
        if not tokens or by_files.get(piece.files, set()) is None:
            by_files[piece.files] = None
        else:
            by_files[piece.files] = by_files.get(piece.files, set()) | tokens
    tests = [f"({files} AND (odd_case OR {answers.any_of(tokens)}))" if tokens else files for files, tokens in by_files.items()]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def scanned(files: DataFrame, pieces: list[Piece], skip: str = "false", more: dict[str, str] | None = None, many: int | None = None,
            hits: list[int] | None = None) -> DataFrame:
    """Per file its (workspace, path), the hits of all pieces and the values of ``more``, in one pass over the contents.

    Files for which ``skip`` holds get no hits. ``more``: SQL over the file's columns and the candidate lines of the pieces.
    ``hits``: numbers of the pieces whose hits are wanted, all by default.
    """
    more = more or {}
    names = [f"cand_{k}" for k in range(len(pieces))]
    found = {n: p.candidates() for n, p in zip(names, pieces)}
    empty = f"cast(array() AS {schemas.HITS})"
    arrays = ", ".join(f"coalesce(cast({p.hits(n)} AS {schemas.HITS}), {empty})" for k, (n, p) in enumerate(zip(names, pieces)) if hits is None or k in hits)
    # files that are skipped have no line candidates; the other pieces look at ``skipped`` here
    found_hits = f"CASE WHEN NOT skipped THEN concat({arrays}) END" if arrays else empty
    texts = [found_hits, *more.values(), *GATE_COLUMNS.values(), *(sql for sql in found.values() if sql)]
    answers = Answers(texts) if many is None else Answers(texts, many)
    staged = files.withColumns({n: F.expr(sql) for n, sql in FILE_COLUMNS.items()} | {"skipped": F.expr(skip)})
    if answers.automatic:
        staged = staged.withColumn("literals_found", answers.column(F.col("lc") if more else F.expr("CASE WHEN NOT skipped THEN lc END")))
    staged = staged.withColumns({n: F.expr(answers.sql(sql)) for n, sql in GATE_COLUMNS.items()})
    staged = staged.withColumn("lines_needed", F.expr(answers.sql(f"NOT skipped AND {lines_needed(pieces, answers)}")))
    staged = staged.withColumns({n: F.expr(sql) for n, sql in LINE_COLUMNS.items()})
    staged = staged.withColumn("nos", F.expr("CASE WHEN size(lines) > 0 THEN sequence(1, size(lines)) END"))
    staged = staged.withColumns({n: F.expr(answers.sql(sql)) for n, sql in found.items() if sql})
    return staged.select("workspace", "path", F.expr(answers.sql(found_hits)).alias("hits"), *(F.expr(answers.sql(sql)).alias(n) for n, sql in more.items()))


def rows_of(scan: DataFrame) -> DataFrame:
    """(workspace, file, detector, type, line, ...) of the hits of ``scanned``."""
    return (
        # the outer form: otherwise Spark infers size(hits) > 0 and evaluates every rule a second time below
        scan.selectExpr("workspace", "path AS file", "inline_outer(hits)")
        .filter("type IS NOT NULL")
    )


def apply(files: DataFrame, pieces: list[Piece]) -> DataFrame:
    """Hits of all pieces in one pass: (workspace, file, detector, type, line, ...)."""
    return rows_of(scanned(files, pieces))
