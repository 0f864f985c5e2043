"""One query per operator (``op<N>_<name>``), each over its whole table, and
the corpus pipeline; with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.tables import table
from .common import prepare

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if oracle:
            ORACLE[key] = oracle
        return run
    return deco


@register("op6_quality_rules")
def _(spark, sf_dir):
    from .quality import quality_report
    return quality_report(table(spark, sf_dir, "documents"))


_SECRET_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, ord, pat) AS (VALUES {rules}),
hits AS (
  SELECT r, kind, ord, t, pat, regexp_extract_all(t, pat) AS h, string_split_regex(t, pat) AS g
  FROM d, rules WHERE regexp_matches(t, pat)),
each AS (
  SELECT r, kind, ord, h[i] AS m, CASE WHEN ord = 0 THEN length(regexp_extract(h[i], pat, 2)) ELSE 8 END AS n,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM hits, unnest(range(1, len(h) + 1)) AS u(i)),
spans AS (SELECT r, kind, ord, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM each WHERE n >= 8),
per AS (
  SELECT r, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
    count(*) FILTER (WHERE ord = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord <= 2) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""


def _secret_sql() -> str:
    from .secrets import RULES
    quoted = [(r.kind, k, r.pattern.replace("'", "''")) for k, r in enumerate(RULES)]
    return _SECRET_SQL.format(rules=", ".join(f"('{k}', {n}, '{p}')" for k, n, p in quoted))


@register("op7_secret_scan", _secret_sql())
def _(spark, sf_dir):
    from .secrets import secret_report
    return secret_report(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_DECON_SQL = rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
items AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least(13, len(w)) AS m FROM items WHERE len(w) > 0) x, unnest(range(1, len(w) - m + 2)) AS u(i)),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM low, lens, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
hits AS (SELECT r, i, m, item_id FROM wins JOIN pats USING (m, p)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hits) c GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@register("op10_decontamination", _DECON_SQL)
def _(spark, sf_dir):
    from .decontamination import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) c USING (doc_id)
"""


@register("op9_near_duplicates", _NEAR_SQL)
def _(spark, sf_dir):
    from .near_dups import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tkey")


@register("op4_source_mixing")
def _(spark, sf_dir):
    from .mixing import mixing_rates
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
rep AS (SELECT r, i FROM wins JOIN (SELECT s FROM wins GROUP BY s HAVING count(*) > 1) x USING (s)),
gone AS (SELECT r, list(DISTINCT k) AS g FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM rep) y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, j: NOT list_contains(g, j)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""


@register("op5_substring_dedup", _SUBSTRING_SQL)
def _(spark, sf_dir):
    from .substrings import substring_dedup
    return substring_dedup(table(spark, sf_dir, "documents"))


@register("op2_token_counts")
def _(spark, sf_dir):
    from .token_counts import read_vocabulary, token_counts
    return token_counts(table(spark, sf_dir, "documents"), read_vocabulary(spark))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN m IS NOT NULL AND m IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""


@register("op8_warc", _WARC_SQL)
def _(spark, sf_dir):
    from .warc import archive_round_trip
    return archive_round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


_LICENSE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, '  ' || array_to_string(w, '  ') || '  ' AS t FROM d),
rules(rule, label, priority, sure, pat) AS (VALUES {rules}),
hits AS (SELECT r, rule, regexp_extract_all(t, pat) AS h, string_split_regex(t, pat) AS g FROM t, rules
  WHERE regexp_matches(t, '{gate}') AND regexp_matches(t, pat)),
f AS (
  SELECT r, rule, CAST((length(before) - length(replace(before, ' ', ''))) // 2 AS BIGINT) AS s, m FROM (
    SELECT r, rule, h[i] AS m, array_to_string(list_transform(range(1, i + 1), lambda x: g[x] || CASE WHEN x < i THEN h[x] ELSE '' END), '') AS before
    FROM hits, unnest(range(1, len(h) + 1)) AS u(i)) y),
spans AS (SELECT r, f.rule, label, priority, sure, s, s + len(string_split(trim(m), '  ')) AS e FROM f JOIN rules ON f.rule = rules.rule),
kept AS (SELECT a.* FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = a.r AND b.s <= a.s AND b.e >= a.e AND b.priority >= a.priority
  AND (b.s, -b.e, -b.priority, b.rule) < (a.s, -a.e, -a.priority, a.rule))),
base AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, list(DISTINCT label) AS l FROM spans WHERE rule < {base} GROUP BY r),
top AS (SELECT r, list(DISTINCT label) AS l, max(sure) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(top.l, [])))), ','), '') AS labels,
  coalesce(CAST(score AS DOUBLE), 0) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN top USING (r)
"""


def _license_sql() -> str:
    from .licenses import BASE, GATE, RULES
    # the same patterns over words parted by two spaces, so that matches need not share one
    rules = ", ".join(f"({k}, '{r.label}', {r.priority}, {r.confidence}, ' {_parted(r.words)} ')" for k, r in enumerate(RULES))
    return _LICENSE_SQL.format(rules=rules, base=len(BASE), gate="|".join(g.replace(" ", "  ") for g in GATE))


def _parted(pattern: str) -> str:
    return pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")


@register("op3_license_scan", _license_sql())
def _(spark, sf_dir):
    from .licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


@register("op1_url_filter")
def _(spark, sf_dir):
    from .url_filters import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages"))


@register("op11_tokenizer_alignment")
def _(spark, sf_dir):
    from .alignment import alignment
    return alignment(table(spark, sf_dir, "documents"))


@register("op12_simhash_near_duplicates")
def _(spark, sf_dir):
    from .simhash import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents"))


_SPELLING_SQL = r"""
WITH RECURSIVE tab AS (SELECT [{table}]::UBIGINT[] AS t),
runs AS (
  SELECT d, run, count(*) AS c, hex(d || ':' || run) AS x FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS u(r) WHERE length(r) >= 5) y GROUP BY d, run),
crc AS (
  SELECT run, c, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substring(x, i, 2))::UBIGINT)),
    lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1]))) AS h FROM runs, tab),
v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
      ELSE run END AS word FROM crc) z
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS s FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.s = b.word),
best AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN other END AS form,
    CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN way ON way.word = f.word JOIN f e ON e.word = way.at AND e.form IS NULL
"""


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


@register("op13_spelling_groups", _SPELLING_SQL.format(table=", ".join(map(str, _crc_table()))))
def _(spark, sf_dir):
    from .spelling import spelling_groups
    return spelling_groups(table(spark, sf_dir, "documents"))
