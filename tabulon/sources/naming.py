"""Column and table naming rules."""

from __future__ import annotations

import re
from collections.abc import Sequence


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Trimmed header cells; blanks become ``Column{n}``, repeats (any case) get a numeric suffix."""
    taken: set[str] = set()
    names = []
    for position, cell in enumerate(cells, 1):
        base = (cell or "").strip() or f"Column{position}"
        name, suffix = base, 2
        while name.lower() in taken:
            name, suffix = f"{base}{suffix}", suffix + 1
        taken.add(name.lower())
        names.append(name)
    return names


def table_name(query: str) -> str:
    """Table name for a query: anything but letters, digits, ``_`` and ``.`` becomes ``_``."""
    return re.sub(r"[^\w.]", "_", query)
