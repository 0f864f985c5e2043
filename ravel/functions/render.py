"""Text templates rendered with ``concat`` (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{\{(\w+)\}\}")


def render(template: str, **cols: Column) -> Column:
    """Concatenate the literal parts of ``template`` with the columns named by
    ``{{name}}`` slots. A null column renders as 'null', as a JavaScript
    template literal does."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(cols[m.group(1)].cast("string"), F.lit("null")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# control characters whose \\uXXXX escape has a hex letter (JSON.stringify writes
# them in lower case; Spark's JSON writer in upper case)
_HEX_LETTER_CTRL = [0x0B, 0x0E, 0x0F] + list(range(0x1A, 0x20))


def json_string(c: Column) -> Column:
    """JSON text of a string value (quoted and escaped), 'null' for null —
    ``JSON.stringify`` of a string."""
    wrapped = F.to_json(F.struct(c.alias("v")))        # {"v":"..."}
    body = F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)
    fixed = body
    for code in _HEX_LETTER_CTRL:
        up = f"{code:04X}"
        # only escapes, not an escaped backslash followed by 'u00..'
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u" + up, "$1\\\\u" + up.lower())
    has_ctrl = c.rlike("[\\x{0B}\\x{0E}\\x{0F}\\x{1A}-\\x{1F}]")
    return F.when(c.isNull(), F.lit("null")).when(has_ctrl, fixed).otherwise(body)
