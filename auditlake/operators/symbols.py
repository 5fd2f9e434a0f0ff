"""Names used by Python sources. Only the parser of the standard library can tell calls from text."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions.text import has_any, lit
from ..rules import needles as N, practice as P


def _call_name(node: ast.AST) -> str | None:
    target = node.func if isinstance(node, ast.Call) else node
    return getattr(target, "id", None) or getattr(target, "attr", None)


def _names(source: str) -> Iterator[tuple[str, str, int, str]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            # the slice counts characters, not lines
            yield "call", _call_name(node), node.lineno, source[max(0, node.lineno - 5):node.lineno]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for decorator in node.decorator_list:
                name = _call_name(decorator)
                if name:
                    yield "decorator", name, decorator.lineno, ""
        elif isinstance(node, ast.Import):
            for alias in node.names:
                yield "import", alias.name, node.lineno, ""
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield "from", node.module, node.lineno, ""
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, node.lineno, ""


NAMES = pa.schema([("workspace", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("symbol", pa.string()), ("lineno", pa.int32()), ("nearby", pa.string())])


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources become Python strings one at a time, whatever the size of a batch."""
    for batch in batches:
        rows = [
            (w.as_py(), p.as_py(), *found)
            for w, p, content in zip(batch["workspace"], batch["path"], batch["content"])
            for found in _names(content.as_py())
        ]
        columns = list(zip(*rows)) or [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NAMES)], schema=NAMES)


def python_symbols(files: DataFrame) -> DataFrame:
    """Calls, decorators, imports and classes of ``.py`` files; unreadable and unparsable files yield nothing."""
    sources = files.filter(f"content IS NOT NULL AND ext = '.py' AND NOT {has_any('path', N.PRACTICE_EXCLUDED_PARTS)}")
    return sources.select("workspace", "path", "content").mapInArrow(_symbols, schemas.SYMBOLS)


CONSENT_SYMBOL = f"(kind IN ('call', 'decorator', 'import', 'from') AND contains(lower(symbol), {lit('consent')}))"
PORTABILITY_SYMBOL = f"(kind = 'call' AND {has_any('lower(symbol)', P.PORTABILITY_CALLS)})"
ACCESS_LOG_SYMBOL = (
    f"((kind = 'call' AND {has_any('lower(symbol)', P.ACCESS_LOG_CALLS)} AND {has_any('lower(nearby)', P.ACCESS_LOG_CONTEXT)})"
    f" OR (kind = 'decorator' AND {has_any('lower(symbol)', P.ACCESS_LOG_DECORATORS)})"
    f" OR (kind = 'class' AND {has_any('lower(symbol)', P.ACCESS_LOG_CLASSES)}))"
)
ERASURE_SYMBOL = (
    f"(kind = 'call' AND {has_any('lower(symbol)', P.ERASURE_WORDS)} AND {has_any('lower(symbol)', P.ERASURE_CALL_SUBJECTS)})"
)


def symbol_flags(files: DataFrame) -> DataFrame:
    """Workspace flags that need parsed sources; workspaces without symbols have no row."""
    return python_symbols(files).groupBy("workspace").agg(
        F.expr(f"bool_or({CONSENT_SYMBOL})").alias("consent_by_symbol"),
        F.expr(f"bool_or({PORTABILITY_SYMBOL})").alias("portability_by_symbol"),
        F.expr(f"bool_or({ACCESS_LOG_SYMBOL})").alias("access_logging_by_symbol"),
        F.expr(f"bool_or({ERASURE_SYMBOL})").alias("erasure_by_symbol"),
    )
