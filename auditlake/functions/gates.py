"""False-positive gates as SQL text, usable in projections and inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

from ..rules import needles as N
from .text import (
    any_rlike, count_any, ends_with_any, has_any, lit, one_of, rlike, starts_with_any, strip, strip_chars,
)

# Names of per-file columns computed once by ``operators.detect.with_file_columns``.
# rooted: '/' + path; lname: lower(name); lc: lower(content)


def excluded_path(parts: str = "parts", name: str = "name", extra_names: tuple[str, ...] = ()) -> str:
    names = N.EXCLUDED_NAMES + list(extra_names)
    dirs = "array(" + ", ".join(lit(d) for d in N.EXCLUDED_DIRS) + ")"
    prefixes = [n[:-1] for n in names if n.endswith("*")]
    clauses = [f"arrays_overlap({parts}, {dirs})", one_of(name, names)]
    if prefixes:
        clauses.append(starts_with_any(name, prefixes))
    return "(" + " OR ".join(clauses) + ")"


def is_detector_code(rooted: str = "lower(rooted)", lc: str = "lc", found: Callable[[str, list[str]], str] = has_any) -> str:
    """``found`` says how the needles of the content are looked for."""
    count = " + ".join(f"int({found(lc, [n])})" for n in N.DETECTOR_CONTENT_NEEDLES)
    return (
        f"({has_any(rooted, N.DETECTOR_PATH_NEEDLES)}"
        f" OR ({count}) >= 2"
        f" OR ({found(lc, ['for pattern'])} AND {found(lc, ['re.search(pattern'])}))"
    )


def pattern_context(lc: str = "lc", found: Callable[[str, list[str]], str] = has_any) -> str:
    return found(lc, N.PATTERN_CONTEXT_NEEDLES)


RAW_STRING = r"""r["'].*["']"""
NAMED_LIST = r"""["'][^"']+["']\s*:\s*\["""


def is_pattern_definition(line: str, context: str = "pattern_context") -> str:
    low = f"lower({strip(line)})"
    return (
        f"(({has_any(low, N.PATTERN_LINE_NEEDLES)} AND {has_any(line, [':', '[', '('])})"
        f" OR ({rlike(line, RAW_STRING, '')} AND ({context} OR {has_any(low, ['pattern', 'regex'])}))"
        f" OR ({rlike(line, NAMED_LIST, '')} AND {has_any(low, ['pattern', 'cipher', 'secret'])}))"
    )


def has_secret_keyword(var: str) -> str:
    up = f"upper({var})"
    return f"({has_any(up, N.SECRET_KEYWORDS)} AND NOT {has_any(up, N.SECRET_KEYWORD_EXEMPT)})"


ALNUM = r"^[\p{L}\p{N}]+\z"
BASE64 = r"^[\p{L}\p{N}+/=]+\z"


def looks_like_secret(value: str) -> str:
    return (
        f"CASE WHEN {value} = '' OR {has_any(f'upper({value})', N.SECRET_FALSE_POSITIVES)} THEN false"
        f" WHEN {has_any(value, N.KNOWN_SECRET_MARKS)} THEN true"
        f" WHEN contains({value}, '-----BEGIN') AND contains({value}, 'PRIVATE KEY') THEN true"
        f" WHEN contains(lower({value}), 'password=') AND length({value}) > 20 THEN true"
        f" WHEN {rlike(value, '^' + N.UUID_REGEX)} THEN true"
        f" WHEN length({value}) >= 20 AND {value} RLIKE {lit(ALNUM)} THEN true"
        f" WHEN length({value}) >= 16 AND {value} RLIKE {lit(BASE64)} THEN true"
        f" ELSE false END"
    )


def test_file(rooted: str = "lower(rooted)", lc: str = "lc", found: Callable[[str, list[str]], str] = has_any) -> str:
    """The part of the test-data gate that depends on the file only."""
    return f"({has_any(rooted, N.TEST_PATH_NEEDLES)} OR {found(lc, N.TEST_CONTENT_NEEDLES)})"


def is_test_data(value: str, file_flag: str = "test_file", ext: str = "ext") -> str:
    return (
        f"({file_flag} OR {has_any(f'lower({value})', N.TEST_VALUE_NEEDLES)}"
        f" OR ({one_of(f'lower({ext})', N.GUID_PROJECT_EXTS)} AND {rlike(value, '^' + N.UUID_REGEX)}))"
    )


def is_comment(line: str, prefixes: list[str]) -> str:
    return starts_with_any(strip(line), prefixes)


def is_code_placeholder_line(line: str) -> str:
    up = f"upper({line})"
    return f"({has_any(up, N.CODE_PLACEHOLDER_WORDS)} AND NOT {has_any(up, N.CODE_PLACEHOLDER_ESCAPES)})"


def is_config_placeholder_line(line: str) -> str:
    return (
        f"({has_any(f'upper({line})', N.CONFIG_PLACEHOLDER_WORDS)}"
        f" AND {has_any(line, N.CONFIG_PLACEHOLDER_CONFIRM)})"
    )


def is_env_reference(value: str) -> str:
    return f"(contains({value}, {lit('${')}) OR startswith({value}, {lit('$')}))"


def is_placeholder_value(value: str) -> str:
    return (
        f"({one_of(f'upper({value})', N.CODE_PLACEHOLDER_VALUES)}"
        f" OR {one_of(f'lower({value})', N.CODE_NULL_VALUES)})"
    )


def unquote(value: str) -> str:
    return strip_chars(value, "'\"")


def unquote_space(value: str) -> str:
    return strip_chars(value, "'\" ")


def code_confidence(value: str, test: str, example: str, comment: str) -> str:
    """Confidence of a code secret; products and sums are in a fixed order for float equality."""
    base = (
        f"(CASE WHEN {test} THEN 0.85D * 0.7D ELSE 0.85D END"
        f" * CASE WHEN {example} THEN 0.6D ELSE 1.0D END"
        f" * CASE WHEN {comment} THEN 0.8D ELSE 1.0D END)"
    )
    return (
        f"CASE WHEN {looks_like_secret(value)} THEN least(0.99D, {base} + 0.1D)"
        f" WHEN length({value}) >= 8 THEN least(0.9D, {base})"
        f" WHEN length({value}) >= 4 THEN greatest(0.5D, {base} - 0.2D)"
        f" ELSE {base} END"
    )


def orm_only(context: str) -> str:
    """Query-builder neighbourhood without raw SQL (the last alternative needs both words)."""
    return (
        f"({has_any(context, N.ORM_NEEDLES)} AND NOT contains({context}, 'raw(')"
        f" AND NOT contains({context}, 'execute(')"
        f" AND NOT (contains({context}, 'query(') AND contains({context}, 'sql')))"
    )


def readme_flag(words: list[str], lc: str = "lower(content)", found: Callable[[str, list[str]], str] = has_any) -> str:
    return f"({one_of('path', N.README_NAMES)} AND {found(lc, words)})"


def workspace_name(workspace: str = "workspace") -> str:
    return f"lower(element_at(split({workspace}, '/'), -1))"


def web_file(lc: str = "lower(content)", excluded: str = "excluded", found: Callable[[str, list[str]], str] = has_any) -> str:
    return (
        f"(({one_of('path', N.WEB_MANIFESTS)} AND {found(lc, N.WEB_FRAMEWORKS)})"
        f" OR {one_of('path', N.WEB_ENTRY_FILES)}"
        f" OR (NOT {excluded} AND {one_of('ext', N.WEB_CODE_EXTS)} AND {found(lc, N.WEB_USER_DATA)}))"
    )


def heuristic_score(snippet: str, context: str, path: str) -> str:
    """Score in 0..1 from ten capped signals, added in a fixed order."""
    s, c, p = f"lower({snippet})", f"lower({context})", f"lower({path})"

    def in_either(words: list[str]) -> str:
        return f"({has_any(c, words)} OR {has_any(p, words)})"

    placeholders = count_any(s, N.SCORE_PLACEHOLDER)
    detectors = "(" + " + ".join(
        f"int(contains({c}, {lit(n)}) OR contains({p}, {lit(n)}))" for n in N.SCORE_DETECTOR) + ")"
    tests = count_any(p, N.SCORE_TEST_PATH)
    real = count_any(s, N.SCORE_REAL)
    detector_context = has_any(c, N.SCORE_DETECTOR)
    steps = [
        f"CASE WHEN {placeholders} > 0 THEN -least(0.4D, 0.2D + {placeholders} * 0.1D) ELSE 0D END",
        f"CASE WHEN {detectors} > 0 THEN -least(0.5D, 0.3D + {detectors} * 0.1D) ELSE 0D END",
        f"CASE WHEN {tests} > 0 THEN -least(0.3D, 0.15D + {tests} * 0.05D) ELSE 0D END",
        f"CASE WHEN {ends_with_any(p, ['.sln', '.csproj', '.vcxproj', '.vcproj'])}"
        f" AND {any_rlike(s, [N.UUID_REGEX])} THEN -0.5D ELSE 0D END",
        f"CASE WHEN {in_either(N.SCORE_SECURITY_TOOL)} THEN -0.3D ELSE 0D END",
        f"CASE WHEN {real} > 0 AND NOT {detector_context} THEN least(0.4D, 0.2D + {real} * 0.1D) ELSE 0D END",
        f"CASE WHEN {has_any(p, N.SCORE_PRODUCTION)} THEN 0.15D ELSE 0D END",
        f"CASE WHEN {has_any(s, N.SCORE_ENV)} OR {has_any(c, N.SCORE_ENV)} THEN -0.25D ELSE 0D END",
        f"CASE WHEN {has_any(s, N.SCORE_KNOWN)} AND NOT {detector_context} THEN 0.3D ELSE 0D END",
        f"CASE WHEN {in_either(N.SCORE_EDUCATIONAL)} THEN -0.2D ELSE 0D END",
    ]
    return "greatest(0D, least(1D, 0.5D + " + " + ".join(steps) + "))"
