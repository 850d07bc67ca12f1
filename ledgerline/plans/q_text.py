"""Registered queries: text cleaning over whole documents and pages
(C19-C31, F9). Oracles restate each rule in DuckDB regex / list SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.jsonfn import canonical_json
from ledgerline.operators.orderdiff import ordered_diff
from ledgerline.operators.textdiff import line_diff
from ledgerline.plans import duck
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.registry import register
from ledgerline.session import spread, table

WS = duck.WS


def docs(spark, sf):
    """Documents with spliced characters, spread over the cores for the
    regex-heavy whole-text passes (a no-op when the scan already has enough
    splits)."""
    return spread(fixture(spark, sf, "docs_spliced"), "doc_id")


def pages(spark, sf):
    return spread(table(spark, sf, "pages"), "page_id")


def _docs_sql(expr: str, alias: str = "text") -> str:
    return with_fixtures(f"SELECT doc_id, {expr} AS {alias} FROM docs_spliced", "docs_spliced")


def _re(x, pat, rep, g=True):
    return f"regexp_replace({x}, '{pat}', '{rep}'{', ' + repr('g') if g else ''})"


# ---- C19 / C20 ---------------------------------------------------------------

def _duck_snake_token(x: str) -> str:
    s = _re(x, f"^{WS}+|{WS}+$", "")
    s = _re(s, f"[^\\pL\\pN\\pM_{WS[1:-1]}]+", " ")
    s = _re(s, f"(?:{WS}|-)+", "_")
    s = _re(s, "([a-z0-9])([A-Z])", "\\1_\\2")
    s = _re(s, "_+", "_")
    return f"lower({_re(s, '^_+|_+$', '')})"


register("c19_snake_token", "C19", _docs_sql(_duck_snake_token("text")))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.snake_token("text").alias("text")))
register("c20_snake_simple", "C20", _docs_sql(f"lower({_re(_re('text', '[^a-zA-Z0-9]+', '_'), '^_+|_+$', '')})"))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.snake_simple("text").alias("text")))
def mode_texts(spark, sf):
    """Texts for every snake-case mode: documents (prose lines), documents
    turned into ``Key Name: value`` lines, comma lines from part rows and JSON
    objects from event properties."""
    d = docs(spark, sf)
    kv = d.select((F.col("doc_id") + 1_000_000_000).alias("id"),
                  F.concat(F.lit("Doc Id: "), F.col("doc_id").cast("string"), F.lit("\nSource Name: x\nplain line"))
                  .alias("text"))
    csv = table(spark, sf, "part").select((F.col("p_partkey") + 2_000_000_000).alias("id"),
                                          F.concat_ws(",", "p_name", "p_brand", "p_type").alias("text"))
    js = table(spark, sf, "events").select((F.col("event_id") + 3_000_000_000).alias("id"),
                                           F.col("props").alias("text"))
    return d.select(F.col("doc_id").alias("id"), "text").unionByName(kv).unionByName(csv).unionByName(js)


_MODE_TEXTS = """
SELECT doc_id AS id, text FROM docs_spliced
UNION ALL SELECT doc_id + 1000000000, concat('Doc Id: ', CAST(doc_id AS VARCHAR), chr(10), 'Source Name: x', chr(10), 'plain line')
  FROM docs_spliced
UNION ALL SELECT p_partkey + 2000000000, concat_ws(',', p_name, p_brand, p_type) FROM part
UNION ALL SELECT event_id + 3000000000, props FROM events
"""
_SNAKE_LINE = f"CASE WHEN {duck.blank('x')} THEN x ELSE {_duck_snake_token('x')} END"
_KV_LINE = (f"CASE WHEN contains(x, ':') THEN concat({_duck_snake_token("split_part(x, ':', 1)")}, ':', "
            f"substring(x, strpos(x, ':') + 1)) WHEN {duck.blank('x')} THEN x ELSE {_duck_snake_token('x')} END")


@register("c21_snake_case_text", "C21/C22", with_fixtures(f"""
SELECT id, CASE
  WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN CAST(json(text) AS VARCHAR)
  WHEN n_colon > 0 AND n_colon >= greatest(1, floor(n_lines * 0.5)) THEN
       array_to_string(list_transform(lines, lambda x: {_KV_LINE}), chr(10))
  WHEN NOT contains(text, chr(10)) AND contains(text, ',') THEN
       array_to_string(list_transform(string_split(text, ','), lambda x: {_duck_snake_token('x')}), ',')
  ELSE array_to_string(list_transform(lines, lambda x: {_SNAKE_LINE}), chr(10)) END AS text
FROM (SELECT id, text, lines, len(lines) AS n_lines, len(list_filter(lines, lambda x: contains(x, ':'))) AS n_colon
      FROM (SELECT id, text, {duck.splitlines('text')} AS lines FROM texts))""",
    "docs_spliced", extra={"texts": _MODE_TEXTS}))
def c21(spark, sf):
    return mode_texts(spark, sf).select("id", T.snake_case_text("text").alias("text"))


@register("c22_snake_json_keys", "C22/C10",
          "SELECT event_id, CAST(json(props) AS VARCHAR) AS props, CAST(json(props) AS VARCHAR) AS canonical FROM events")
def c22(spark, sf):
    e = spread(table(spark, sf, "events"), "event_id")
    return e.select("event_id", T.snake_json_keys("props").alias("props"), canonical_json("props").alias("canonical"))


@register("c22_nested_json_keys", "C22", """
SELECT event_id, concat('{"outer_key":{"inner_key":', event_id, ',"list_of":[{"deep_key":', coalesce(user_id, 0), '},"a: \\"b\\": c",null]}}') AS props,
       concat('[{"user_id":', coalesce(user_id, 0), '},["Not A Key"]]') AS items FROM events""")
def c22_nested(spark, sf):
    u = F.coalesce("user_id", F.lit(0))
    props = F.concat(F.lit('{"Outer Key":{"Inner-Key":'), "event_id", F.lit(',"list Of":[{"Deep Key":'), u, F.lit('},"a: \\"b\\": c",null]}}'))
    items = F.concat(F.lit('[{"User ID":'), u, F.lit('},["Not A Key"]]'))
    return spread(table(spark, sf, "events"), "event_id").select("event_id", T.snake_json_keys(props).alias("props"), T.snake_json_keys(items).alias("items"))


# ---- C23 / C24 / C25 ----------------------------------------------------------

def _duck_emoji(x: str, strict: bool) -> str:
    enclosed = r"\x{24C2}-\x{1F251}" if strict else r"\x{24C2}\x{1F170}-\x{1F251}"
    emoji = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}"
             + enclosed + r"\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}]+")
    return _re(_re(x, emoji, ""), r"[\x{200D}\x{200C}\x{FE0E}\x{FE0F}]", "")


register("c23_remove_emoji_safe", "C23", _docs_sql(_duck_emoji("text", False)))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.remove_emoji("text").alias("text")))
register("c23_remove_emoji_strict", "C23", _docs_sql(_duck_emoji("text", True)))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.remove_emoji("text", strict=True).alias("text")))


def _duck_tidy_common(s: str, whole: bool) -> str:
    s = f"replace({s}, chr(160), ' ')"
    s = _re(s, r"[\x{2010}-\x{2015}\x{2212}]", " - ")
    if whole:
        s = _re(s, f"{WS}+-{WS}+|{WS}+-|-{WS}+", " - ")
    s = _re(s, f"([\\(\\[\\{{]){WS}+", "\\1")
    s = _re(s, f"{WS}+([\\)\\]\\}}])", "\\1")
    if whole:
        s = _re(s, f"\\({WS}*\\)", "")
        s = _re(s, f"\\[{WS}*\\]", "")
        s = _re(s, f"\\{{{WS}*\\}}", "")
    else:
        s = _re(s, f"[\\(\\[\\{{]{WS}*[\\)\\]\\}}]", "")
    s = _re(s, f"{WS}+([,.;:!?])", "\\1")
    return _re(s, "[ \\t\\f\\x0b]+", " ")


_NORM = (f"array_to_string(list_transform({duck.splitlines(_duck_tidy_common('text', True))}, "
         f"lambda x: {duck.rstrip('x')}), chr(10))")
register("c24_normalize_text", "C24", _docs_sql(_NORM))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.normalize_text("text").alias("text")))

_RULE = f"^{WS}*(-({WS}*-){{2,}}|\\*({WS}*\\*){{2,}}|_({WS}*_){{2,}}){WS}*$"
_NORM_LINES = (f"array_to_string(list_transform({duck.splitlines('text')}, lambda x: CASE WHEN "
               f"regexp_matches(x, '{_RULE}') THEN x ELSE {duck.rstrip(_duck_tidy_common('x', False))} END), chr(10))")
register("c25_normalize_lines", "C25", _docs_sql(_NORM_LINES))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.normalize_lines("text").alias("text")))


# ---- C26 PHP pairs over serialised part records --------------------------------

def php_records(spark, sf):
    p = table(spark, sf, "part")

    def pair(k, v):
        return F.concat(F.lit(f's:{len(k)}:"{k}";s:'), F.length(v).cast("string"), F.lit(':"'), v, F.lit('";'))
    return p.select(F.col("p_partkey").alias("part_key"), F.concat(
        F.lit("a:4:{"), pair("name", F.col("p_name")), pair("brand", F.col("p_brand")),
        pair("type", F.when(F.col("p_partkey") % 5 == 0, F.lit("N/A")).otherwise(F.col("p_type"))),
        pair("name", F.upper("p_name")), F.lit("}")).alias("text"))


_PHP_SQL = """
SELECT p_partkey AS part_key, concat('a:4:{',
  's:4:"name";s:', CAST(length(p_name) AS VARCHAR), ':"', p_name, '";',
  's:5:"brand";s:', CAST(length(p_brand) AS VARCHAR), ':"', p_brand, '";',
  's:4:"type";s:', CAST(length(t) AS VARCHAR), ':"', t, '";',
  's:4:"name";s:', CAST(length(upper(p_name)) AS VARCHAR), ':"', upper(p_name), '";', '}') AS text
FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE p_type END AS t FROM part)
"""


@register("c26_php_pairs", "C26", with_fixtures("""
SELECT part_key, array_to_string(list_transform(
         list_filter(pairs, lambda x, i: NOT coalesce(list_bool_or(list_transform(pairs[i + 1:], lambda y: y.k = x.k)), false)),
         lambda x: concat(x.k, '=', x.v)), '&') AS pairs
FROM (SELECT part_key, list_filter(list_zip(regexp_extract_all(text, 's:[0-9]+:"(.*?)";s:[0-9]+:"(.*?)";', 1),
                                           regexp_extract_all(text, 's:[0-9]+:"(.*?)";s:[0-9]+:"(.*?)";', 2)),
                                  lambda p: NOT (contains(p[1], '";') OR contains(p[1], 'a:') OR contains(p[1], 'i:')
                                            OR contains(p[1], 'b:') OR contains(p[1], 'N') OR contains(p[2], 'a:')
                                            OR contains(p[2], 'i:') OR contains(p[2], 'b:') OR contains(p[2], 'N'))
                                  ) AS raw
      FROM php),
LATERAL (SELECT list_transform(raw, lambda p: {'k': p[1], 'v': p[2]}) AS pairs)
""", extra={"php": _PHP_SQL}))
def c26(spark, sf):
    m = T.php_pairs(F.col("text"))
    return php_records(spark, sf).select(
        "part_key", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                 "&").alias("pairs"))


# ---- C27 / C28 / C29 / C30 / C31 --------------------------------------------------


@register("c27_text_counts", "C27", with_fixtures(
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(CASE WHEN text = '' THEN 0 ELSE "
    "len(string_split(text, chr(10))) END AS BIGINT) AS lines FROM docs_spliced", "docs_spliced"))
def c27(spark, sf):
    return docs(spark, sf).select("doc_id", T.char_count("text").cast("bigint").alias("chars"),
                                  T.line_count("text").cast("bigint").alias("lines"))


@register("c28_count_pattern", "C28", with_fixtures(
    "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits "
    "FROM docs_spliced", "docs_spliced"))
def c28(spark, sf):
    return docs(spark, sf).select("doc_id", T.count_occurrences("text", "The").alias("hits"))


_L = duck.splitlines("text")
_C29 = (f"concat(array_to_string(list_transform(list_filter(list_transform({_L}, lambda x, i: {{'l': x, 'i': i}}), "
        f"lambda e: NOT {duck.blank('e.l')} OR e.i <= 2 OR "
        f"len(list_filter(({_L})[e.i - 2:e.i], lambda y: NOT {duck.blank('y')})) > 0), "
        f"lambda e: CASE WHEN {duck.blank('e.l')} THEN '' ELSE {duck.rstrip('e.l')} END), chr(10)), "
        f"CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END)")
register("c29_collapse_blank_lines", "C29", _docs_sql(_C29))(
    lambda spark, sf: docs(spark, sf).select("doc_id", T.collapse_blank_lines("text").alias("text")))

# comments, quoted ones, escaped quotes, scripts, and an open comment at the end of some pages
_SPLICED_HTML = ("concat('<p title=\"a <!-- kept --> b\">it <!-- gone \n \" --> is</p>', html, '\n<i x=''<!-- kept''>', "
                 "'<SCRIPT a=1>if (a <!-- kept --> b) don''t();</script >', CASE WHEN page_id % 3 = 0 THEN '<!-- open \"' ELSE '\"ends \\\\' END)")
_RUN_SQL = r"""("(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z))"""
_SPLICED_DUCK = _SPLICED_HTML.replace("\\\\", "\\")


def spliced_pages(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(_SPLICED_HTML).alias("html"))


register("c30_drop_html_comments", "C30", f"""
SELECT page_id, regexp_replace({_SPLICED_DUCK}, '(?s){_RUN_SQL}|<!--.*?(?:-->|\\z)', '\\1', 'g') AS html FROM pages""")(
    lambda spark, sf: spliced_pages(spark, sf).select("page_id", T.drop_html_comments("html").alias("html")))
register("c30_keep_scripts", "C30", f"""
SELECT page_id, regexp_replace({_SPLICED_DUCK},
  '(?s)(<(?i:script)\\b[^>]*>.*?(?:</(?i:script)\\s*>|\\z))|{_RUN_SQL}|<!--.*?(?:-->|\\z)', '\\1\\2', 'g') AS html FROM pages""")(
    lambda spark, sf: spliced_pages(spark, sf).select("page_id", T.drop_html_comments("html", keep_scripts=True).alias("html")))


@register("c31_base64_media", "C31", """
SELECT page_id, to_base64(encode(html)) AS content,
       CASE WHEN lower(regexp_extract(url, '\\.([^./]*)$', 1)) IN ('', 'jpg', 'jpeg') THEN 'image/jpeg'
            ELSE concat('image/', lower(regexp_extract(url, '\\.([^./]*)$', 1))) END AS mime
FROM pages""")
def c31(spark, sf):
    p = pages(spark, sf)
    return p.select("page_id", T.base64_text(F.encode("html", "UTF-8")).alias("content"),
                    T.mime_of("url").alias("mime"))


# ---- F9 line diff: documents before and after blank-line collapsing ----------------


@register("f9_line_diff", "F9", with_fixtures(f"""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line, b.line) AS line,
       CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'input' ELSE 'output' END AS side,
       CAST(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS BIGINT) AS n
FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest({duck.splitlines('text')}) AS line
      FROM docs_spliced) GROUP BY ALL) a
FULL OUTER JOIN (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest({duck.splitlines('text')}) AS line
      FROM (SELECT doc_id, {_NORM} AS text FROM docs_spliced)) GROUP BY ALL) b
  ON a.doc_id = b.doc_id AND a.line = b.line
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""", "docs_spliced"))
def f9(spark, sf):
    d = docs(spark, sf)
    return line_diff(d, d.select("doc_id", T.normalize_text("text").alias("text")))


# ---- F9 ordered: documents before and after lines are dropped, edited, repeated, moved ----

_LINES = f"""SELECT doc_id, n, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n
  FROM (SELECT doc_id, {duck.splitlines('text')} AS l FROM docs_spliced))"""
_EDIT = "CASE WHEN (n * 3 + doc_id) % 11 = 0 THEN concat(line, ' (edited)') ELSE line END"
_PLACE = "CASE WHEN (n + doc_id) % 9 = 4 THEN 2 * n + 13 ELSE 2 * n END"
_DROP = "(n + doc_id) % 7 = 0"
_AGAIN = "(n + doc_id) % 6 = 1"


def _runs(pairs: str, name: str) -> str:
    """CTEs that keep a longest ascending run of each key and gap, by piles."""
    return f"""
{name}_l AS (SELECT doc_id, gap, list_reduce(list_prepend(CAST([] AS STRUCT(k BIGINT, i BIGINT, j BIGINT, size BIGINT)[]),
    list([{{'k': k, 'i': i, 'j': j, 'size': 0}}] ORDER BY k)), lambda acc, x: list_append(acc, {{'k': x[1].k, 'i': x[1].i, 'j': x[1].j,
    'size': 1 + coalesce(list_max(list_transform(list_filter(acc, lambda y: y.j < x[1].j), lambda y: y.size)), 0)}})) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS k FROM ({pairs})) GROUP BY doc_id, gap),
{name}_p AS (SELECT doc_id, gap, unnest(p, recursive := true) FROM {name}_l),
{name}_top AS (SELECT doc_id, gap, max(size) AS size, arg_max(k, (size, k)) AS k FROM {name}_p GROUP BY doc_id, gap),
{name}_w AS (
  SELECT doc_id, gap, size, k FROM {name}_top
  UNION ALL SELECT w.doc_id, w.gap, w.size - 1, (SELECT max(p.k) FROM {name}_p p WHERE p.doc_id = w.doc_id AND p.gap = w.gap AND p.size = w.size - 1 AND p.k < w.k)
  FROM {name}_w w WHERE w.size > 1),
{name} AS (SELECT p.doc_id, p.i, p.j FROM {name}_w w JOIN {name}_p p ON p.doc_id = w.doc_id AND p.gap = w.gap AND p.k = w.k)"""


def _gaps(lines: str, number: str, matches: str) -> str:
    return (f"SELECT l.*, m.{number} IS NOT NULL AS match, coalesce(sum(CASE WHEN m.{number} IS NULL THEN 0 ELSE 1 END) OVER "
            f"(PARTITION BY l.doc_id ORDER BY l.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap "
            f"FROM {lines} l LEFT JOIN {matches} m ON m.doc_id = l.doc_id AND m.{number} = l.n")


_F9_ORDERED = with_fixtures("SELECT 1", "docs_spliced").removeprefix("WITH ").removesuffix("SELECT 1").strip()
_F9_ORDERED = f"""WITH RECURSIVE {_F9_ORDERED},
a AS ({_LINES}),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, again) AS n, line FROM (
  SELECT doc_id, {_PLACE} AS place, 0 AS again, {_EDIT} AS line FROM a WHERE NOT {_DROP}
  UNION ALL SELECT doc_id, {_PLACE}, 1, {_EDIT} FROM a WHERE {_AGAIN} AND NOT {_DROP})),
a1 AS (SELECT doc_id, line, min(n) AS i FROM a GROUP BY doc_id, line HAVING count(*) = 1),
b1 AS (SELECT doc_id, line, min(n) AS j FROM b GROUP BY doc_id, line HAVING count(*) = 1),
{_runs("SELECT doc_id, 0 AS gap, i, j FROM a1 JOIN b1 USING (doc_id, line)", "anchors")},
a2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap, line ORDER BY n) AS o FROM ({_gaps("a", "i", "anchors")}) WHERE NOT match),
b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap, line ORDER BY n) AS o FROM ({_gaps("b", "j", "anchors")}) WHERE NOT match),
{_runs("SELECT doc_id, gap, a2.n AS i, b2.n AS j FROM a2 JOIN b2 USING (doc_id, gap, line, o)", "between")},
m AS (SELECT * FROM anchors UNION ALL SELECT * FROM between),
rows_ AS (
  SELECT g.doc_id, g.gap, CASE WHEN g.match THEN 2 ELSE 0 END AS phase, g.n, g.n AS i, m.j, g.line FROM ({_gaps("a", "i", "m")}) g
    LEFT JOIN m ON m.doc_id = g.doc_id AND m.i = g.n
  UNION ALL SELECT doc_id, gap, 1, n, NULL, n, line FROM ({_gaps("b", "j", "m")}) WHERE NOT match),
near AS (SELECT *, max(CASE WHEN phase < 2 THEN gap END) OVER (PARTITION BY doc_id ORDER BY gap, phase, n) AS last,
  min(CASE WHEN phase < 2 THEN gap END) OVER (PARTITION BY doc_id ORDER BY gap, phase, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM rows_),
kept AS (SELECT *, lag(gap) OVER w AS g0, lag(phase) OVER w AS p0, row_number() OVER w AS position FROM near
  WHERE phase < 2 OR gap - last < 3 OR next - gap <= 3 WINDOW w AS (PARTITION BY doc_id ORDER BY gap, phase, n))
SELECT doc_id, CAST(sum(CASE WHEN g0 IS NULL OR gap > g0 + CASE WHEN p0 = 2 THEN 1 ELSE 0 END THEN 1 ELSE 0 END) OVER (
         PARTITION BY doc_id ORDER BY position) AS INTEGER) AS hunk, CAST(position AS INTEGER) AS position,
       ['-', '+', ' '][phase + 1] AS op, CAST(i AS INTEGER) AS before_line, CAST(j AS INTEGER) AS after_line, line FROM kept
"""


def _edited(text):
    """The later version of a text, in one pass over its lines; null if none is left."""
    placed = F.expr(f"""flatten(transform(lines, (line, at) -> flatten(transform(array(at + 1), n ->
        transform(CASE WHEN {_DROP} THEN filter(array(0), again -> false) WHEN {_AGAIN} THEN array(0, 1) ELSE array(0) END,
                  again -> named_struct('place', {_PLACE}, 'again', again, 'line', {_EDIT}))))))""")
    lines = F.transform(F.array_sort("placed"), lambda x: x["line"])
    joined = F.when(F.size("placed") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return (text.select("doc_id", T.split_lines(F.col("text")).alias("lines")).select("doc_id", placed.alias("placed"))
            .select("doc_id", joined.alias("text")))


@register("f9_ordered_diff", "F9", _F9_ORDERED)
def f9_ordered(spark, sf):
    d = docs(spark, sf)
    return ordered_diff(d, _edited(d))
