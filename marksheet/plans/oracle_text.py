"""DuckDB text of the normalizers, generated from the same fixed lists as the Spark versions.

Used only as the correctness oracle for the registered queries (ASCII fixtures: DuckDB's
regex classes are ASCII, Spark's are set to Unicode with ``(?U)``).
"""

from __future__ import annotations

from marksheet.functions import normalize as N
from marksheet.functions.strings import PY_WHITESPACE


def lit(v: str) -> str:
    """A DuckDB string expression for ``v`` (newlines as chr(10))."""
    parts = v.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if v else "''"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def _chain(src: str, steps: list[str], key: str = "p_partkey") -> str:
    """CTEs c0..cn, each step an expression of ``s`` from the previous CTE."""
    ctes = [f"c0 AS (SELECT {key}, answer, {src} AS s FROM src)"]
    for i, e in enumerate(steps, 1):
        ctes.append(f"c{i} AS (SELECT {key}, answer, {e} AS s FROM c{i - 1})")
    return ",\n".join(ctes), f"c{len(steps)}"


def _units_list() -> str:
    items = ", ".join(
        "{'pat': " + lit(f"(^|\\W){u}($|\\W)") + ", 'key': " + lit(N._unit_literal_key(u)) + "}" for u in N.UNIT_WORDS
    )
    return f"[{items}]"


def math_profile_steps() -> list[str]:
    t = N.number_word_table()
    keys = "[" + ", ".join(lit(k) for k in t) + "]"
    vals = "[" + ", ".join(lit(v) for v in t.values()) + "]"
    wkey = f"trim(regexp_replace(replace(lower(s), '-', ' '), '\\s+', ' ', 'g'), {WS})"
    months = "|".join(N.MONTHS)
    steps = [
        f"trim(s, {WS})",
        "replace(replace(rtrim(replace(s, chr(10), ''), '.'), '\\!', ''), '', '')",
        "replace(regexp_replace(regexp_replace(s, '\\\\begin\\{array\\}\\{.*?\\}', '\\\\begin{pmatrix}', 'g'), '\\\\end\\{array\\}', '\\\\end{pmatrix}', 'g'), 'bmatrix', 'pmatrix')",
        "replace(replace(replace(replace(replace(s, 'tfrac', 'frac'), 'dfrac', 'frac'), '\\neq', '\\ne'), '\\leq', '\\le'), '\\geq', '\\ge')",
        "replace(replace(replace(replace(s, '\\left', ''), '\\right', ''), '\\{', '{'), '\\}', '}')",
        f"CASE WHEN trim(regexp_replace(s, '\\\\text\\{{.*?\\}}$', ''), {WS}) <> '' AND trim(regexp_replace(s, '\\\\text\\{{.*?\\}}$', ''), {WS}) <> s "
        f"THEN trim(regexp_replace(s, '\\\\text\\{{.*?\\}}$', ''), {WS}) ELSE s END",
        f"list_reduce({_units_list()}, lambda acc, u: CASE WHEN contains(acc, u.key) "
        "THEN coalesce(nullif(regexp_replace(acc, u.pat, '\\1\\2', 'g'), ''), acc) ELSE acc END, s)",
        "replace(replace(replace(replace(replace(replace(s, '^{\\circ}', ''), '^\\circ', ''), '\\$', ''), '$', ''), '\\(', ''), '\\)', '')",
        f"CASE WHEN regexp_full_match(s, '[0-9]+') THEN regexp_replace(s, '^0+([0-9])', '\\1') "
        f"ELSE coalesce(({vals})[list_position({keys}, {wkey})], s) END",
        "regexp_replace(s, '\\\\text\\{(.*?)\\}', '\\1', 'g')",
    ]
    s = "s"
    for k in ("x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"):
        s = f"replace({s}, {lit(k)}, '')"
    steps.append(s)
    steps += [
        "replace(replace(replace(replace(s, '\\emptyset', '{}'), '(-\\infty,\\infty)', '\\mathbb{R}'), '\\%', ''), '%', '')",
        f"regexp_replace(s, '(?i)\\b({months})\\b', '', 'g')",
        "replace(replace(s, ' .', ' 0.'), '{.', '{0.')",
        "replace(s, 'infinity', '\\infty')",
        "CASE WHEN NOT contains(s, '\\infty') THEN replace(s, 'inf', '\\infty') ELSE s END",
        "replace(s, '+\\inity', '\\infty')",
        "regexp_replace(replace(replace(s, 'and', ''), '\\mathbf', ''), '\\\\mbox\\{.*?\\}', '', 'g')",
        "CASE WHEN contains(s, 'j') AND NOT contains(s, 'i') THEN replace(s, 'j', 'i') ELSE s END",
        "regexp_replace(regexp_replace(s, '(\\d+)\\.0*([^\\d])', '\\1\\2', 'g'), '(\\d+)\\.0*$', '\\1')",
        "CASE WHEN s LIKE '.%' THEN '0' || s ELSE s END",
        "CASE WHEN len(string_split(s, '=')) = 2 AND length(string_split(s, '=')[1]) <= 2 THEN string_split(s, '=')[2] ELSE s END",
        "replace(regexp_replace(s, '\\\\sqrt(\\w+)', '\\\\sqrt{\\1}', 'g'), ' ', '')",
        "CASE WHEN len(string_split(s, '\\frac')) <= 1 THEN s "
        "WHEN list_bool_or(list_transform(string_split(s, '\\frac')[2:], lambda p: NOT starts_with(p, '{') AND length(p) < 2)) THEN s "
        "ELSE string_split(s, '\\frac')[1] || array_to_string(list_transform(string_split(s, '\\frac')[2:], lambda p: '\\frac' || "
        "CASE WHEN starts_with(p, '{') THEN p WHEN substr(p, 2, 1) <> '{' THEN '{' || substr(p, 1, 1) || '}{' || substr(p, 2, 1) || '}' || substr(p, 3) "
        "ELSE '{' || substr(p, 1, 1) || '}' || substr(p, 2) END), '') END",
        "CASE WHEN len(string_split(s, '/')) = 2 "
        "AND (contains(string_split(s, '/')[1], 'sqrt') OR regexp_full_match(string_split(s, '/')[1], '-?[1-9][0-9]*|0')) "
        "AND (contains(string_split(s, '/')[2], 'sqrt') OR regexp_full_match(string_split(s, '/')[2], '-?[1-9][0-9]*|0')) "
        "THEN '\\frac{' || string_split(s, '/')[1] || '}{' || string_split(s, '/')[2] || '}' ELSE s END",
    ]
    return steps


def math_profile_sql(source_sql: str, key: str = "p_partkey") -> str:
    """``SELECT key, answer, normalized`` for ``source_sql`` (columns key, answer)."""
    ctes, last = _chain("coalesce(answer, 'None')", math_profile_steps(), key)
    return f"WITH src AS ({source_sql}),\n{ctes}\nSELECT {key}, answer, s AS normalized FROM {last}"


def final_profile_sql(source_sql: str, key: str = "p_partkey") -> str:
    s = "string_split(s, '=')[-1]"
    for old, new in N.FINAL_SUBSTITUTIONS:
        s = f"replace({s}, {lit(old)}, {lit(new)})"
    for old in N.FINAL_REMOVED:
        s = f"replace({s}, {lit(old)}, '')"
    steps = [
        s,
        "regexp_replace(s, '(.*?)(\\$)(.*?)(\\$)(.*)', '$\\3$', 'g')",
        "regexp_replace(s, '(\\\\text\\{)(.*?)(\\})', '\\2', 'g')",
        "regexp_replace(s, '(\\\\textbf\\{)(.*?)(\\})', '\\2', 'g')",
        "regexp_replace(s, '(\\\\overline\\{)(.*?)(\\})', '\\2', 'g')",
        "regexp_replace(s, '(\\\\boxed\\{)(.*)(\\})', '\\2', 'g')",
        "regexp_replace(s, '(frac)([^{])(.)', 'frac{\\2}{\\3}', 'g')",
        "replace(regexp_replace(s, '(sqrt)([^{])', 'sqrt{\\2}', 'g'), '$', '')",
        "CASE WHEN regexp_full_match(replace(s, ',', ''), '[0-9]+') THEN replace(s, ',', '') ELSE s END",
        "CASE WHEN s LIKE '%.0' AND regexp_full_match(left(s, length(s) - 2), '[0-9]+') THEN left(s, length(s) - 2) ELSE s END",
        "CASE WHEN s LIKE '%.00' AND regexp_full_match(left(s, length(s) - 3), '[0-9]+') THEN left(s, length(s) - 3) ELSE s END",
        "CASE WHEN s LIKE '%\\%' ESCAPE '\\' AND regexp_full_match(left(s, length(s) - 1), '[0-9]+') THEN left(s, length(s) - 1) ELSE s END",
        "CASE WHEN lower(s) IN ('a', 'b', 'c', 'd', 'e', 'f', 'g') THEN lower(s) ELSE s END",
    ]
    ctes, last = _chain("CAST(answer AS VARCHAR)", steps, key)
    return f"WITH src AS ({source_sql}),\n{ctes}\nSELECT {key}, answer, s AS normalized FROM {last}"


def clean_units_sql(source_sql: str, key: str = "p_partkey") -> str:
    steps = [
        "regexp_replace(s, '(^|[^0-9}])\\\\?π', '\\13.14', 'g')",
        "regexp_replace(s, '([0-9])(\\\\?π)', '\\1*3.14', 'g')",
        "regexp_replace(regexp_replace(s, '\\{(\\\\?π)\\}', '3.14', 'g'), '\\*(\\\\?π)', '*3.14', 'g')",
        "replace(replace(replace(replace(replace(replace(s, '%', '/100'), '$', ''), '¥', ''), '°C', ''), ' C', ''), '°', '')",
    ]
    ctes, last = _chain("replace(answer, '\\pi', 'π')", steps, key)
    return f"WITH src AS ({source_sql}),\n{ctes}\nSELECT {key}, s AS cleaned FROM {last}"


def parse_number_sql(x: str) -> str:
    """N7 on expression ``x``: commas dropped, Python float syntax, else a trailing percent / 100."""
    c = f"replace({x}, ',', '')"
    return (f"CASE WHEN regexp_full_match({c}, '\\s*[+-]?([0-9](_?[0-9])*(\\.([0-9](_?[0-9])*)?)?|\\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?\\s*') "
            f"THEN CAST(replace({c}, '_', '') AS DOUBLE) "
            f"WHEN {c} LIKE '%\\%' ESCAPE '\\' AND regexp_full_match(rtrim(left({c}, length({c}) - 1), '\\'), '[+-]?[0-9]+(\\.[0-9]*)?') "
            f"THEN CAST(rtrim(left({c}, length({c}) - 1), '\\') AS DOUBLE) / 100 END")


def grade_exact_sql(pred_sql: str, gold_sql: str, key: str = "p_partkey") -> str:
    """G13 over two (key, answer) sources: normalized equality or numeric distance <= 1e-5."""
    a = math_profile_sql(pred_sql, key)
    b = math_profile_sql(gold_sql, key)
    pa, pb = parse_number_sql("a.normalized"), parse_number_sql("b.normalized")
    return (f"SELECT a.{key}, coalesce(a.normalized = b.normalized, false) OR coalesce(abs(({pa}) - ({pb})) <= 1e-5, false) AS exact_match "
            f"FROM ({a}) a JOIN ({b}) b USING ({key})")
