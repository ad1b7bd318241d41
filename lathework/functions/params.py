"""Parsing of user-supplied parameters and checks on the schema (driver side, no data)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

TOLERANCE = 1e-6


def name_list(value: str | Iterable[str] | None) -> list[str]:
    """Names separated by commas or blanks, trimmed, empties dropped."""
    if value is None:
        return []
    parts = [value] if isinstance(value, str) else list(value)
    return [token for part in parts for token in re.split(r"[,\s]+", part) if token]


def field_list(values: Iterable[str]) -> list[str]:
    """Field names separated by commas only, so a name may hold blanks."""
    return [field.strip() for value in values for field in value.split(",") if field.strip()]


def _numbers(texts: Iterable[str]) -> list[float]:
    found, wrong = [], []
    for text in texts:
        (found if re.fullmatch(r"\s*[0-9]*\.?[0-9]+(e-?[0-9]+)?\s*", text, re.I) else wrong).append(text)
    if wrong:
        raise ValueError(f"not positive numbers: {', '.join(map(repr, wrong))}")
    return [float(text) for text in found]


def checked_shares(shares: list[float]) -> list[float]:
    """Shares as fractions. Their sum says what they are: 1 for fractions, 100 for percentages; anything else is refused."""
    total = sum(shares)
    scale = next((unit for unit in (1, 100) if abs(total - unit) <= TOLERANCE * unit), None)
    if scale is None or min(shares, default=0) <= 0:
        raise ValueError("shares must be positive and sum to 1, or to 100 as percentages")
    return [share / scale for share in shares]


def percentages(value: str) -> list[float]:
    """Positive shares in a list of numbers, fractions or percentages."""
    return checked_shares(_numbers(name_list(value)))


def share_mapping(value: str | Mapping[str, float]) -> dict[str, float]:
    """Named shares, checked like unnamed ones: a mapping, ``{"train": 0.9, "test": 0.1}`` as JSON, or ``train:0.9,test:0.1``."""
    if isinstance(value, str):
        plain = value.strip()
        if plain.startswith("{"):
            value = json.loads(plain)
        else:
            named = [part.rsplit(":", 1) for part in name_list(plain)]
            if any(len(part) != 2 or not part[0] for part in named):
                raise ValueError(f"expected name:share, got {plain!r}")
            value = dict(zip([n for n, _ in named], _numbers(share for _, share in named)))
    return dict(zip(map(str, value), checked_shares([float(x) for x in value.values()]))) if value else {}


def require_any(columns: Iterable[str], wanted: Mapping[str, Iterable[str]]) -> None:
    """Each requirement is met by any of its candidate columns; all failures are reported at once."""
    present = set(columns)
    missing = [label for label, names in wanted.items() if not present.intersection(names)]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {sorted(present)}")


def resolve_alias(columns: Iterable[str], primary: str | None, aliases: Iterable[str] = ()) -> str | None:
    """The primary column if the table has it, else the first alias it has, else None."""
    present = set(columns)
    for name in [primary, *aliases]:
        if name in present:
            return name
    return None
