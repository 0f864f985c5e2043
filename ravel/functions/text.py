"""Column helpers that reproduce JavaScript string/regex/JSON semantics with

Each regex helper has a Java form (for Spark) and an RE2 form (for the DuckDB
oracle SQL), because the two engines differ in word boundaries and look-arounds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word character, as JavaScript's \b and \w see it.
_W = "[0-9A-Za-z_]"

# JavaScript's \s / String.prototype.trim() set (D3).
JS_SPACE = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- trim

_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c) -> Column:
    """``String.prototype.trim``: strip JS white space at both ends. Looks at
    the ends only, where a regular expression would look at every place."""
    return F.btrim(col_(c), F.lit(_SPACES))


def sql_js_trim(expr: str) -> str:
    """DuckDB form of :func:`js_trim`."""
    return f"regexp_replace({expr}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"


# ------------------------------------------------------------- word regexes

def _starts_word(alt: str) -> bool:
    return alt[:1].isalnum() or alt[:1] == "_"


def _ends_word(alt: str) -> bool:
    # A literal ')' written as '\)' is a non-word end (D5); a group ')' is not.
    return not alt.endswith("\\)")


def words_java(alts, case_insensitive: bool = True) -> str:
    """Java regex equal to JavaScript ``/\\b(a|b|...)\\b/`` (ASCII ``\\b``).

    ``\\b`` means "the word/non-word state changes", so its meaning depends
    on the first/last character of each alternative: after ``O\\(n\\)`` the
    next character must be a word character (D5). Consecutive alternatives
    with the same guards share one guard pair, and a look-ahead on the
    possible first letters skips most positions cheaply; both keep the
    alternatives' order and the set of matches."""
    groups: list[tuple[str, str, list[str]]] = []
    for a in alts:
        lead = f"(?<!{_W})" if _starts_word(a) else f"(?<={_W})"
        trail = f"(?!{_W})" if _ends_word(a) else f"(?={_W})"
        if groups and groups[-1][0] == lead and groups[-1][1] == trail:
            groups[-1][2].append(a)
        else:
            groups.append((lead, trail, [a]))
    firsts = sorted({a[0].lower() for a in alts if a[0].isalpha()} | {a[0].upper() for a in alts if a[0].isalpha()})
    pre = f"(?=[{''.join(firsts)}])" if all(a[0].isalpha() for a in alts) else ""
    parts = [f"{lead}(?:{'|'.join(g)}){trail}" for lead, trail, g in groups]
    flag = "(?i)" if case_insensitive else ""
    return flag + pre + "(?:" + "|".join(parts) + ")"


def _literal(alt: str) -> str:
    """Lower-case text that every match of an alternative begins with."""
    m = re.match(r"(?:[A-Za-z0-9_ '/-]|\\[^A-Za-z0-9])*", alt).group()
    if re.match(r"[?*{]", alt[len(m):]):      # the last character may be missing
        m = m[:-2] if m[-2:-1] == "\\" else m[:-1]
    return re.sub(r"\\(.)", r"\1", m).lower()


def has_words(c, alts) -> Column:
    """``c.rlike(words_java(alts))``. A text that contains none of the plain
    beginnings of the alternatives cannot match, which a search for fixed
    strings tells much faster; lower case maps A-Z alone to a-z, so it hides
    none of them."""
    literals = sorted({_literal(a) for a in alts}, key=lambda x: (len(x), x))
    literals = [x for i, x in enumerate(literals) if not any(y in x for y in literals[:i])]   # a shorter one tells already

    def some(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(F.lit(x)) for x in literals])

    c = col_(c)
    # the lambda binds the lower-cased text, which is made once
    return F.transform(F.array(F.lower(c)), some)[0] & c.rlike(words_java(alts))


def words_re2(alts, case_insensitive: bool = True) -> str:
    """RE2 form (DuckDB): RE2's ``\\b`` is ASCII, as in JavaScript."""
    flag = "(?i)" if case_insensitive else ""
    return flag + r"\b(" + "|".join(alts) + r")\b"


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ falsy

def falsy_to(c, default, kind: str = "string") -> Column:
    """JavaScript ``x || default``: null, '' (strings) or 0 (numbers) → default."""
    c = col_(c)
    empty = (c == "") if kind == "string" else (c == 0)
    return F.when(c.isNull() | empty, default).otherwise(c)


# ------------------------------------------------------------------- JSON

def is_strict_json(c) -> Column:
    """True when ``JSON.parse`` would accept the text.

    ``try_parse_json`` alone accepts trailing text; wrapping the text as an
    array element and as an object value rejects trailing text, empty input
    and multiple values."""
    c = col_(c)
    a = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    o = F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}")))
    return c.isNotNull() & a.isNotNull() & o.isNotNull()


def parse_json_strict(c) -> Column:
    """Variant of the text when it is strict JSON, else null."""
    c = col_(c)
    a = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    o = F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}")))
    return F.when(a.isNotNull() & o.isNotNull(), F.try_variant_get(a, "$[0]", "variant"))


def variant_type(v: Column, path: str) -> Column:
    """JSON type name of a variant field ('STRING', 'BIGINT', 'VOID' for JSON
    null, ...); SQL null when the field is missing (D8)."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))
