"""DuckDB oracle: the same inputs and operators as plain SQL over the
driver's views (``part documents labels conversations embeddings events``).

Written independently of the Spark code paths: list functions and lambdas
instead of Spark higher-order functions, RE2 instead of Java regex (the
patterns in ``fixed`` are written so that both engines read them alike).
"""

from __future__ import annotations

from . import fixed

# Doubles are rounded on both sides before hashing.
DIGITS = 6


def lit(s: str) -> str:
    """A DuckDB string literal; control characters go through chr()."""
    out, buf = [], []
    for ch in s:
        if ch == "'" or ch.isprintable():
            buf.append("''" if ch == "'" else ch)
        else:
            if buf:
                out.append("'" + "".join(buf) + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
    if buf or not out:
        out.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


# --- scalar building blocks ------------------------------------------------

def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit(fixed.PY_STRIP_RE)}, '', 'g')"


def clean_question(e: str) -> str:
    x = f"translate({e}, {lit(fixed.CURLY_QUOTES + chr(9))}, '''''''''')"
    return f"replace({strip(x)}, chr(10), '')"


def postprocess(e: str) -> str:
    return f"split_part(replace({e}, chr(10), ''), ';', 1)"


def semicolon(e: str) -> str:
    return f"CASE WHEN ends_with({e}, ';') THEN {e} ELSE {e} || ';' END"


def quotes(e: str) -> str:
    return f"replace({e}, '\"', '''')"


def tokens(e: str) -> str:
    return f"array_to_string(regexp_extract_all({e}, {lit(fixed.TOKEN_RE)}), ' ')"


def lower_outside(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, ''''), "
            f"lambda x, i: CASE WHEN i % 2 = 1 THEN lower(x) ELSE x END), '''')")


def asc(e: str) -> str:
    keys = f"regexp_extract_all({e}, {lit(fixed.ORDER_BY_RE)})"
    return (f"CASE WHEN contains({e}, 'order by') AND NOT contains({e}, 'asc') AND NOT contains({e}, 'desc') "
            f"THEN list_reduce({keys}, lambda acc, k: replace(acc, k, k || ' asc'), {e}) ELSE {e} END")


def alias(e: str) -> str:
    region = f"CASE WHEN position('from ' IN {e}) > 0 THEN substr({e}, position('from ' IN {e})) ELSE '' END"
    al = f"regexp_extract_all({region}, {lit(fixed.ALIAS_RE)}, 2)"
    tb = f"regexp_extract_all({region}, {lit(fixed.ALIAS_RE)}, 1)"
    names = "[" + ", ".join(f"'{a}'" for a in fixed.ALIASES) + "]"
    table_of = f"list_filter(list_zip({al}, {tb}), lambda p: p[1] = a)[-1][2]"
    return (f"list_reduce({names}, lambda acc, a: CASE WHEN ({table_of}) IS NULL THEN acc "
            f"ELSE replace(replace(acc, 'as ' || a || ' ', ''), a, {table_of}) END, {e})")


def tabs(e: str) -> str:
    return f"replace({e}, chr(9), '')"


STAGES = [("strip", strip), ("semicolon", semicolon), ("quotes", quotes), ("tokens", tokens),
          ("lower", lower_outside), ("asc", asc), ("alias", alias), ("tabs", tabs)]


def normalize_ctes(src: str, col: str, key: str, upto: str | None = None, prefix: str = "n") -> tuple[str, str]:
    """A chain of CTEs, one per stage; returns (cte text, last cte name)."""
    ctes, prev, cur_col = [], src, col
    for i, (name, fn) in enumerate(STAGES):
        cte = f"{prefix}{i}"
        ctes.append(f"{cte} AS (SELECT * EXCLUDE ({cur_col}), {fn(cur_col)} AS {cur_col} FROM {prev})")
        prev = cte
        if name == upto:
            break
    return ",\n".join(ctes), prev


# --- stand-in inputs (mirror plans/standins.py) ----------------------------

CAT_ENTRIES = """
names AS (SELECT p_brand AS db_id, p_type AS tbl, p_name AS col, min(p_partkey) AS k FROM part GROUP BY ALL),
tabs_ AS (SELECT db_id, tbl, min(k) AS tk,
                 row_number() OVER (PARTITION BY db_id ORDER BY min(k)) - 1 AS tbl_ord
          FROM names GROUP BY db_id, tbl),
cat AS (SELECT n.db_id, n.tbl, n.col,
               CASE WHEN ends_with(n.col, ' bolt') OR ends_with(n.col, ' rod') THEN 'number' ELSE 'text' END AS col_type,
               t.tbl_ord, row_number() OVER (PARTITION BY n.db_id ORDER BY n.k) AS col_ord, n.k = t.tk AS is_pk
        FROM names n JOIN tabs_ t USING (db_id, tbl)),
cat_cols AS (SELECT db_id, tbl, col, col_type, CAST(tbl_ord AS INTEGER) AS tbl_ord, CAST(col_ord AS INTEGER) AS col_ord
             FROM cat
             UNION ALL
             SELECT db_id, tbl, '*', 'text', CAST(tbl_ord AS INTEGER), 0 FROM tabs_),
cat_pks AS (SELECT db_id, tbl, col, col_ord,
                   CAST(row_number() OVER (PARTITION BY db_id ORDER BY col_ord) - 1 AS INTEGER) AS pk_ord
            FROM cat WHERE is_pk),
cat_fks AS (SELECT db_id, tbl AS tbl1, col AS col1,
                   lag(tbl) OVER (PARTITION BY db_id ORDER BY pk_ord) AS tbl2,
                   lag(col) OVER (PARTITION BY db_id ORDER BY pk_ord) AS col2,
                   pk_ord - 1 AS fk_ord
            FROM cat_pks QUALIFY pk_ord >= 1),
tab_lines AS (SELECT db_id, tbl, 'Table ' || tbl || ', columns = [' || string_agg(col, ',' ORDER BY col_ord) || ']' || chr(10) AS line
              FROM cat_cols GROUP BY db_id, tbl),
schemas AS (SELECT d.db_id,
                   d.tables_str || 'Foreign_keys = ' || coalesce(f.fk_str, '[]' || chr(10)) || chr(10)
                   || 'Primary_keys = ' || coalesce(p.pk_str, '[]' || chr(10)) AS schema_str
            FROM (SELECT db_id, string_agg(line, '' ORDER BY tbl) AS tables_str FROM tab_lines GROUP BY db_id) d
            LEFT JOIN (SELECT db_id, '[' || string_agg(tbl1 || '.' || col1 || ' = ' || tbl2 || '.' || col2, ',' ORDER BY fk_ord) || ']' AS fk_str
                       FROM cat_fks GROUP BY db_id) f USING (db_id)
            LEFT JOIN (SELECT db_id, '[' || string_agg(tbl || '.' || col, ',' ORDER BY pk_ord) || ']' || chr(10) AS pk_str
                       FROM cat_pks GROUP BY db_id) p USING (db_id))
"""

SAMPLE_SQL = (
    "CASE WHEN lang = 'en' THEN 'SELECT T1.lang , count(*) FROM documents AS T1 JOIN labels AS T2 "
    "ON T1.doc_id = T2.doc_id WHERE T1.source = \"' || source || '\" ORDER BY count(*)' "
    "WHEN lang = 'fr' THEN 'select doc_id from documents where n_chars > ' || CAST(n_chars AS VARCHAR) || ' order by doc_id desc;' "
    "WHEN lang = 'de' THEN 'SELECT source FROM documents ORDER BY source , n_chars' "
    "ELSE 'SELECT description FROM documents AS T1 WHERE T1.n_chars >= ' || CAST(n_chars AS VARCHAR) || ' ORDER BY T1.doc_id' END"
)

SAMPLES = f"""
samples AS (SELECT doc_id AS ord, 'TS_' || CAST(doc_id AS VARCHAR) AS id,
                   'Brand#' || CAST(CAST(substr(source, 4) AS INTEGER) + 1 AS VARCHAR) AS db_id,
                   text AS question, {SAMPLE_SQL} AS query
            FROM documents)
"""

LABELS = """
lbl AS (SELECT 'TS_' || CAST(doc_id AS VARCHAR) AS id,
               CASE WHEN quality = 0 THEN 'null'
                    ELSE 'SELECT count(*) FROM documents AS T1 WHERE T1.doc_id = ' || CAST(doc_id AS VARCHAR)
                         || ' AND T1.toxic = ' || CAST(toxic AS VARCHAR) END AS sql
        FROM labels),
questions AS (SELECT doc_id AS ord, 'TS_' || CAST(doc_id AS VARCHAR) AS id, text AS question FROM documents)
"""

PART_SQL = """
part_sql AS (SELECT p_partkey AS id,
  CASE p_type
    WHEN 'ECONOMY' THEN 'SELECT T1.' || split_part(p_name, ' ', 1) || ' , count(*) FROM ' || replace(p_brand, '#', '_')
         || ' AS T1 JOIN orders AS T2 ON T1.p_partkey = T2.o_custkey WHERE T1.' || split_part(p_name, ' ', 2)
         || ' = "' || p_name || '" ORDER BY count(*)'
    WHEN 'LARGE' THEN 'select ' || split_part(p_name, ' ', 1) || ' from part order by ' || split_part(p_name, ' ', 2) || ' desc;'
    WHEN 'MEDIUM' THEN 'SELECT ' || split_part(p_name, ' ', 1) || ' FROM part ORDER BY ' || split_part(p_name, ' ', 1)
         || ' , ' || split_part(p_name, ' ', 2)
    WHEN 'PROMO' THEN 'SELECT description , T1.* FROM part T1 WHERE p_size = ' || CAST(p_size AS VARCHAR)
         || ' AND p_comment = ''It T1'' ORDER BY ' || split_part(p_name, ' ', 2)
    WHEN 'SMALL' THEN '  SELECT ' || split_part(p_name, ' ', 1) || ' FROM ' || split_part(p_name, ' ', 2)
         || ' AS T1 WHERE T1.p_size >= ' || CAST(p_size AS VARCHAR) || chr(28)
    ELSE 'select Имя , ' || split_part(p_name, ' ', 1) || ' from Город as t1 join ' || split_part(p_name, ' ', 2)
         || ' as t10 on t1.p_partkey = t10.p_size order by Имя'
  END AS sql
  FROM part)
"""


def render_message(role: str, content: str) -> str:
    return (f"{lit(fixed.HEADER_START)} || {role} || {lit(fixed.HEADER_END + chr(10) * 2)} || "
            f"{strip(content)} || {lit(fixed.END_OF_TURN)}")


def render_chat(phase: str, question: str, schema: str, answer: str | None) -> str:
    user = f"'QUESTION: ' || {question} || chr(10) || 'DATABASE SCHEMA: ' || {schema} || chr(10)"
    parts = [lit(fixed.BOS), render_message("'system'", lit(fixed.INSTRUCTION)), render_message("'user'", user)]
    if phase == "train":
        parts.append(render_message("'assistant'", answer))
    else:
        parts.append(lit(fixed.ASSISTANT_HEADER))
    return " || ".join(parts)


def codepoints(e: str) -> str:
    return f"list_transform(string_split({e}, ''), lambda ch: unicode(ch))"


def rnd(e: str) -> str:
    return f"round({e}, {DIGITS})"
