"""Compile ``{column}`` templates into one concatenation expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{([^{}]+)\}")


def render(template: str, fields: Iterable[str] | Mapping[str, Column]) -> Column:
    """Substitute each known field once; NULL gives an empty text, unknown fields stay as written."""
    known = fields if isinstance(fields, Mapping) else {name: F.col(f"`{name}`") for name in fields}
    parts: list[Column] = []
    end = 0
    for match in _FIELD.finditer(template):
        if match.group(1) not in known:
            continue
        if match.start() > end:
            parts.append(F.lit(template[end : match.start()]))
        parts.append(F.coalesce(known[match.group(1)].cast("string"), F.lit("")))
        end = match.end()
    if end < len(template) or not parts:
        parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def placeholders(template: str) -> list[str]:
    """Field names a template mentions, in order."""
    return [match.group(1) for match in _FIELD.finditer(template)]
