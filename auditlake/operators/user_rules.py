"""Rules supplied by a user, scanned in the same pass as the built-in ones."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.gates import is_comment
from ..functions.text import lit, one_of, rlike
from ..rules import needles as N
from .detect import LINE, FileRule, LineRules, Piece, hit, metadata


@dataclass(frozen=True)
class UserRule:
    name: str
    pattern: str
    exts: tuple[str, ...]
    scope: str  # "line" or "file"
    type: str
    severity: str
    confidence: float


def register_rules(rules: list[UserRule]) -> list[Piece]:
    """Pieces for ``scan_files(extra=...)``: one row per (file, rule), comments skipped for line rules."""
    out: list[Piece] = []
    for rule in rules:
        if rule.severity not in ("critical", "high", "medium", "low") or not 0.0 <= rule.confidence <= 1.0:
            raise ValueError(f"rule {rule.name}: severity or confidence out of range")
        files = one_of("ext", list(rule.exts)) if rule.exts else "true"
        if rule.scope == "line":
            out.append(LineRules(rule.name, [(rule.pattern, rule.name)], files, rule.type, lit(rule.severity),
                                 f"{rule.confidence}D", lines=f"NOT {is_comment(LINE, N.COMMENTS_CODE)}"))
        elif rule.scope == "file":
            out.append(FileRule(files, rlike("content", rule.pattern),
                                hit(rule.name, rule.type, "NULL", lit(rule.name), lit(rule.severity),
                                    f"{rule.confidence}D", metadata({"issue": lit(rule.name)})), (rule.pattern,)))
        else:
            raise ValueError(f"rule {rule.name}: scope is 'line' or 'file'")
    return out
