"""Plain-text output of results and listings."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import Any, TextIO


def _cell(value: Any, width: int, right: bool) -> str:
    text = f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)
    return text.rjust(width) if right else text.ljust(width)


def _is_number(value: Any) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True


def cat(result: Iterable[tuple], width: int = 80, header: list[str] | None = None, numeric: list[bool] | None = None, out: TextIO | None = None) -> None:
    """Print rows in columns; numbers (judged by the first row) stand on the right, with thousands separated."""
    out = out or sys.stdout
    rule = "=" * width
    if header:
        cell = max(1, width // len(header))
        sides = numeric or [False] * len(header)
        print(rule, " ".join(_cell(h, cell, r) for h, r in zip(header, sides)), rule, sep="\n", file=out)
    for row in result:
        if numeric is None:
            numeric = [_is_number(v) for v in row]
        cell = max(1, width // max(1, len(row)))
        print(" ".join(_cell(v, cell, r) for v, r in zip(row, numeric)), file=out)


def columns(items: list[str], width: int = 80, each: int = 3, out: TextIO | None = None) -> None:
    """Print names, a few to a line."""
    for at in range(0, len(items), each):
        print(" ".join(i.ljust(width // each) for i in items[at : at + each]).rstrip(), file=out or sys.stdout)
