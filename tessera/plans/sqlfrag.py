"""Small helpers that spell our Column expressions as DuckDB SQL for the oracle twins."""
from __future__ import annotations

from typing import Sequence

from ..functions.clean import _is_literal
from ..functions.tokens import PY_SPACE


def q(s: str) -> str:
    """SQL string literal (standard SQL: quotes doubled, backslashes literal)."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Java pattern -> RE2: drop the Java-only flags; (?U)\\d becomes \\p{Nd}."""
    if pattern.startswith("(?U)"):
        pattern = pattern[4:].replace(r"\d", r"\p{Nd}")
    return pattern.replace("(?d)", "")


def re2_repl(rep: str) -> str:
    return rep.replace("$1", "\\1")


def fold_rules(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    for pat, rep in rules:
        if _is_literal(pat):
            expr = f"replace({expr}, {q(pat)}, {q(rep)})"
        else:
            expr = f"regexp_replace({expr}, {q(re2(pat))}, {q(re2_repl(rep))}, 'g')"
    return expr


def ws_split(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(PY_SPACE)}), lambda x: x <> '')"


def str_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def keyed_normal_sql(seed: int, *key: str) -> str:
    """The keyed draw of the encoders with ``method='md5'``."""
    def uniform(k):
        text = " || '|' || ".join([q(str(k)), *[f"coalesce(cast({c} as varchar), '')" for c in key]])
        return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0)"
    return f"(sqrt(-2.0 * ln({uniform(2 * seed)})) * cos(2 * pi() * {uniform(2 * seed + 1)}))"
