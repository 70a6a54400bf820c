"""DuckDB SQL for every registered query that has an SQL equivalent."""

from __future__ import annotations

from . import oracle as O

ORACLE: dict[str, str] = {}

CONST_DB = "Brand#1"
BATCH_SIZE = 12
ONE_BATCH = 4


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip()) + "\n"


# --- catalog ---------------------------------------------------------------
ORACLE["catalog_columns"] = _with(O.CAT_ENTRIES) + "SELECT db_id, tbl, col, col_type, tbl_ord, col_ord FROM cat_cols"
ORACLE["catalog_primary_keys"] = _with(O.CAT_ENTRIES) + "SELECT db_id, tbl, col, pk_ord FROM cat_pks"
ORACLE["catalog_foreign_keys"] = _with(O.CAT_ENTRIES) + (
    "SELECT db_id, tbl1, col1, tbl2, col2, CAST(fk_ord AS INTEGER) AS fk_ord FROM cat_fks")
ORACLE["schema_strings"] = _with(O.CAT_ENTRIES) + "SELECT db_id, schema_str FROM schemas"
ORACLE["schema_strings_grouped"] = ORACLE["schema_strings"]

# --- questions and generated SQL -------------------------------------------
RAW_Q = ("raw_q AS (SELECT 'TS_' || CAST(doc_id AS VARCHAR) AS id, "
         "chr(9) || ' ‘' || replace(text, chr(10), ' ' || chr(10) || chr(9)) || '’ “' || lang || '” ' || chr(10) "
         "AS question FROM documents)")
ORACLE["clean_questions"] = _with(RAW_Q) + f"SELECT id, {O.clean_question('question')} AS question FROM raw_q"
ORACLE["postprocess_sql"] = (
    f"SELECT 'TS_' || CAST(doc_id AS VARCHAR) AS id, {O.postprocess("(text || ';x')")} AS sql "
    "FROM documents")

for _stage in ("semicolon", "quotes", "tokens", "lower", "asc", "alias", None):
    _ctes, _last = O.normalize_ctes("part_sql", "sql", "id", upto=_stage)
    ORACLE[f"norm_{_stage}" if _stage else "normalize_sql"] = _with(O.PART_SQL, _ctes) + f"SELECT id, sql FROM {_last}"

# --- joins and filters -----------------------------------------------------
ORACLE["attach_schema"] = _with(O.CAT_ENTRIES, O.SAMPLES) + (
    "SELECT s.id, s.db_id, c.schema_str FROM samples s JOIN schemas c USING (db_id)")
ORACLE["attach_schema_const"] = _with(O.CAT_ENTRIES, O.LABELS) + (
    f"SELECT q.id, c.schema_str FROM questions q CROSS JOIN (SELECT schema_str FROM schemas WHERE db_id = '{CONST_DB}') c")
ORACLE["attach_labels"] = _with(O.LABELS) + "SELECT q.id, l.sql FROM questions q JOIN lbl l USING (id)"
ORACLE["labels_quarantine"] = _with(O.LABELS) + (
    "SELECT q.ord, q.id, CAST(length(q.question) AS INTEGER) AS n_chars FROM questions q ANTI JOIN lbl l USING (id)")
ORACLE["missing_labels"] = _with(O.LABELS) + "SELECT q.id FROM questions q ANTI JOIN lbl l USING (id)"
ORACLE["drop_unanswerable"] = _with(O.LABELS) + (
    "SELECT q.id, l.sql FROM questions q JOIN lbl l USING (id) WHERE l.sql IS NOT NULL AND l.sql <> 'null'")


# --- prompts ---------------------------------------------------------------
def _pauq(phase: str) -> str:
    base = ("pq AS (SELECT s.ord, s.id, " + O.clean_question("s.question") + " AS question, s.query AS answer, "
            "c.schema_str FROM samples s JOIN schemas c USING (db_id))")
    ctes = [O.CAT_ENTRIES, O.SAMPLES, base]
    last = "pq"
    if phase == "train":
        nctes, last = O.normalize_ctes("pq", "answer", "id", prefix="pn")
        ctes.append(nctes)
    return _with(*ctes) + (
        f"SELECT ord, id, {O.render_chat(phase, 'question', 'schema_str', 'answer')} AS text FROM {last}")


def _ehrsql(phase: str) -> str:
    keep = "WHERE l.sql IS NOT NULL AND l.sql <> 'null'" if phase == "train" else ""
    base = ("eq AS (SELECT q.ord, q.id, " + O.clean_question("q.question") + " AS question, l.sql AS answer, "
            f"c.schema_str FROM questions q JOIN lbl l USING (id) "
            f"CROSS JOIN (SELECT schema_str FROM schemas WHERE db_id = '{CONST_DB}') c {keep})")
    ctes = [O.CAT_ENTRIES, O.LABELS, base]
    last = "eq"
    if phase == "train":
        nctes, last = O.normalize_ctes("eq", "answer", "id", prefix="en")
        ctes.append(nctes)
    return _with(*ctes) + (
        f"SELECT ord, id, {O.render_chat(phase, 'question', 'schema_str', 'answer')} AS text FROM {last}")


ORACLE["build_prompts_train"] = _pauq("train")
ORACLE["build_prompts_test"] = _pauq("test")
ORACLE["ehrsql_prompts_train"] = _ehrsql("train")
ORACLE["ehrsql_prompts_test"] = _ehrsql("test")
ORACLE["chat_render"] = (
    f"SELECT conv_id, {O.lit('<|begin_of_text|>')} || string_agg({O.render_message('role', 'text')}, '' ORDER BY turn) "
    "AS text FROM conversations GROUP BY conv_id")
ORACLE["first_batch"] = f"SELECT * FROM ({_ehrsql('train')}) ORDER BY ord LIMIT {ONE_BATCH}"
ORACLE["batch_ids"] = (
    f"SELECT ord, id, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id "
    f"FROM ({_ehrsql('train')})")


# --- tokens ----------------------------------------------------------------
from . import fixed  # noqa: E402

MAX_SEQ, PROFILE_LIMIT, PAD_ID, TRAIN_LEN = 256, 1024, 0, 3072
TRAIN_BS, TRAIN_GAS, TRAIN_EPOCHS = 1, 17, 3.0

DOC_TOKENS = (f"dt AS (SELECT 'TS_' || CAST(doc_id AS VARCHAR) AS id, source, text, {O.codepoints('text')} AS ids "
              "FROM documents)")
ORACLE["tokenize_codepoints"] = _with(DOC_TOKENS) + (
    "SELECT id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS cp_sum, "
    "CAST(coalesce(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)), 0) AS BIGINT) AS cp_wsum FROM dt")
ORACLE["truncate"] = _with(DOC_TOKENS) + (
    f"SELECT id, CAST(len(ids[1:{MAX_SEQ}]) AS BIGINT) AS n_tokens, array_to_string(ids[1:{MAX_SEQ}], ',') AS input_ids FROM dt")


def _pad_sql(side: str) -> str:
    t = f"tr AS (SELECT id, ids[1:{MAX_SEQ}] AS ids FROM dt), L AS (SELECT max(len(ids)) AS L FROM tr)"
    fill = f"list_transform(range(L - len(ids)), lambda x: {PAD_ID})"
    ones = "list_transform(range(len(ids)), lambda x: 1)"
    zeros = "list_transform(range(L - len(ids)), lambda x: 0)"
    if side == "right":
        ids, mask = f"list_concat(ids, {fill})", f"list_concat({ones}, {zeros})"
    else:
        ids, mask = f"list_concat({fill}, ids)", f"list_concat({zeros}, {ones})"
    return _with(DOC_TOKENS, t) + (
        f"SELECT id, array_to_string({ids}, ',') AS input_ids, array_to_string({mask}, ',') AS attention_mask "
        "FROM tr CROSS JOIN L")


ORACLE["pad_left"] = _pad_sql("left")
ORACLE["pad_right"] = _pad_sql("right")
ORACLE["length_profile"] = _with(DOC_TOKENS) + (
    f"SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE n = {PROFILE_LIMIT}) AS n_at_limit, "
    f"round(coalesce(sum(n) FILTER (WHERE n <> {PROFILE_LIMIT}), 0) / count(*), 6) AS mean_len_compat, "
    f"round(avg(n), 6) AS mean_len "
    f"FROM (SELECT source, least(len(ids), {PROFILE_LIMIT}) AS n FROM dt) GROUP BY source")
ORACLE["step_budget"] = (
    "SELECT source, n_rows, spe AS steps_per_epoch, tot AS total_steps, "
    f"CAST(floor({fixed.WARMUP_FRACTION} * tot) AS BIGINT) AS warmup_steps, spe AS save_steps FROM ("
    f"SELECT source, n_rows, spe, CAST(ceil({TRAIN_EPOCHS} * spe) AS BIGINT) AS tot FROM ("
    f"SELECT source, count(*) AS n_rows, CAST(greatest(floor(count(*) / {TRAIN_BS * TRAIN_GAS}), 1) AS BIGINT) AS spe "
    "FROM documents GROUP BY source))")
ORACLE["roundtrip_failures"] = (
    "SELECT source, count(*) AS n_checked, CAST(0 AS BIGINT) AS n_failures FROM documents "
    f"WHERE length(text) < {PROFILE_LIMIT} GROUP BY source")

_HDR = [ord(c) for c in fixed.ASSISTANT_HEADER]
_K = len(_HDR)
ORACLE["completion_labels"] = (
    "WITH pt AS (SELECT id, " + O.codepoints("text") + " AS ids FROM (" + ORACLE["build_prompts_train"] + ")), "
    f"hs AS (SELECT id, ids, list_max(list_filter(range(1, len(ids) - {_K} + 2), "
    f"lambda i: ids[i] = {_HDR[0]} AND ids[i:i + {_K - 1}] = {_HDR})) AS st FROM pt) "
    "SELECT id, CAST(len(ids) AS BIGINT) AS n_tokens, "
    f"CAST(CASE WHEN st IS NULL THEN 0 ELSE len(ids) - (st + {_K - 1}) END AS BIGINT) AS n_labels, "
    f"CAST(CASE WHEN st IS NULL THEN 0 ELSE coalesce(list_sum(ids[st + {_K}:]), 0) END AS BIGINT) AS label_sum FROM hs")

_CUT = f"substr(text, 1, {TRAIN_LEN})"
ORACLE["train_tokens"] = (
    f"WITH pt AS (SELECT id, {_CUT} AS t, {O.codepoints(_CUT)} AS ids FROM ({ORACLE['build_prompts_train']})), "
    f"hs AS (SELECT id, ids, list_max(list_filter(range(1, len(ids) - {_K} + 2), "
    f"lambda i: ids[i] = {_HDR[0]} AND ids[i:i + {_K - 1}] = {_HDR})) AS st FROM pt), "
    f"tl AS (SELECT id, ids, list_filter(CASE WHEN st IS NULL THEN [] ELSE ids[st + {_K}:] END, lambda x: x <> {PAD_ID}) AS kept FROM hs) "
    f"SELECT id, CAST({TRAIN_LEN} AS BIGINT) AS n_tokens, CAST(len(kept) AS BIGINT) AS n_labels, "
    f"CAST(coalesce(list_sum(ids), 0) + {PAD_ID} * ({TRAIN_LEN} - len(ids)) AS BIGINT) AS id_sum, "
    "CAST(coalesce(list_sum(kept), 0) AS BIGINT) AS label_sum FROM tl")

# --- confidence ------------------------------------------------------------
_ENT = ("SELECT vec_id, v, list_max(v) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v "
        "FROM embeddings)")
ORACLE["step_entropy"] = (
    "SELECT vec_id, round(ln(z) - s / z, 6) AS entropy FROM ("
    "SELECT vec_id, list_sum(list_transform(v, lambda x: exp(x - m))) AS z, "
    "list_sum(list_transform(v, lambda x: CASE WHEN x = '-inf'::DOUBLE THEN 0 ELSE (x - m) * exp(x - m) END)) AS s "
    f"FROM ({_ENT}))")
ORACLE["step_entropy_long"] = ORACLE["step_entropy"]

GEN_LOG = ("gl AS (SELECT user_id, event_id, ts, value, event_type = 'error' AS is_eos FROM events), "
           "fe AS (SELECT user_id, min(ts) AS first_eos FROM gl WHERE is_eos GROUP BY user_id), "
           "kept AS (SELECT gl.* FROM gl LEFT JOIN fe USING (user_id) WHERE fe.first_eos IS NULL OR gl.ts <= fe.first_eos)")
ORACLE["truncate_scores"] = "WITH " + GEN_LOG + " SELECT user_id, event_id, value FROM kept"
ORACLE["confidence"] = ("WITH " + GEN_LOG +
                        " SELECT user_id, count(*) AS n_steps, max(value) AS score FROM kept GROUP BY user_id")
ORACLE["last_by_id"] = ("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, "
                        "arg_max(value, event_id) AS value FROM events GROUP BY user_id")
ORACLE["union_batches"] = ("SELECT doc_id AS ord, 'TS_' || CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en' "
                           "UNION ALL SELECT doc_id, 'TS_' || CAST(doc_id AS VARCHAR) FROM documents WHERE lang IS DISTINCT FROM 'en'")
ORACLE["stream_prompts_test"] = ORACLE["build_prompts_test"]


# --- rendering parts, counts, array-form scoring ------------------------------
ORACLE["table_lines"] = _with(O.CAT_ENTRIES) + (
    "SELECT db_id, string_agg(line, '' ORDER BY tbl) AS tables_str FROM tab_lines GROUP BY db_id")
ORACLE["fk_strings"] = _with(O.CAT_ENTRIES) + (
    "SELECT db_id, '[' || string_agg(tbl1 || '.' || col1 || ' = ' || tbl2 || '.' || col2, ',' ORDER BY fk_ord) || ']' "
    "AS fk_str FROM cat_fks GROUP BY db_id")
ORACLE["pk_strings"] = _with(O.CAT_ENTRIES) + (
    "SELECT db_id, '[' || string_agg(tbl || '.' || col, ',' ORDER BY pk_ord) || ']' || chr(10) AS pk_str "
    "FROM cat_pks GROUP BY db_id")
ORACLE["max_len"] = _with(DOC_TOKENS) + f"SELECT CAST(max(least(len(ids), {MAX_SEQ})) AS INTEGER) AS max_len FROM dt"
ORACLE["prompt_counts"] = _with(O.LABELS) + (
    "SELECT 'train' AS split, count(*) AS n_rows FROM questions q JOIN lbl l USING (id) "
    "WHERE l.sql IS NOT NULL AND l.sql <> 'null' "
    "UNION ALL SELECT 'test', count(*) FROM questions q JOIN lbl l USING (id)")

_STEPS = ("vs AS (SELECT vec_id, list_transform(range(CAST(ceil(len(embedding) / 8.0) AS BIGINT)), lambda s: list_transform(embedding[s * 8 + 1: s * 8 + 8], "
          "lambda x: CAST(x AS DOUBLE))) AS st FROM embeddings), "
          "ve AS (SELECT vec_id, st, list_transform(st, lambda l: ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) "
          "- list_sum(list_transform(l, lambda x: (x - list_max(l)) * exp(x - list_max(l)))) "
          "/ list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS ent, "
          "list_concat([0, 0, 7], list_transform(st, lambda l: list_position(l, list_max(l)) - 1)) AS seq FROM vs)")
ORACLE["step_entropies"] = (
    f"WITH {_STEPS} SELECT vec_id, array_to_string(list_transform(ent, lambda h: printf('%.6f', h)), ',') AS entropies FROM ve")


def _array_scores_sql(start: int) -> str:
    tail = f"seq[{start}:]"
    return (f"WITH {_STEPS}, cut AS (SELECT vec_id, ent, coalesce(list_position({tail}, 0), 0) AS p FROM ve) "
            "SELECT vec_id, CAST(CASE WHEN p = 0 THEN len(ent) ELSE least(p, len(ent)) END AS BIGINT) AS n_steps, "
            "round(list_max(CASE WHEN p = 0 THEN ent ELSE ent[1:p] END), 6) AS score FROM cut")


ORACLE["truncate_scores_array"] = _array_scores_sql(4)
ORACLE["truncate_scores_compat"] = _array_scores_sql(2)
ORACLE["strip_prompt"] = (
    "WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), "
    "a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') "
    f"SELECT conv_id, turn, CAST(len({O.codepoints('a.text')}) AS BIGINT) AS n_gen, "
    f"CAST(coalesce(list_sum({O.codepoints('a.text')}), 0) AS BIGINT) AS gen_sum FROM u JOIN a USING (conv_id, turn)")


# --- generation with the stand-in model ----------------------------------------
def _tok_entropy(tok: str) -> str:
    v = f"(-abs(k - {tok} % 32) * (0.5 + ({tok} % 7) / 4.0))"
    z = f"list_sum(list_transform(range(32), lambda k: exp({v})))"
    return f"(ln({z}) - list_sum(list_transform(range(32), lambda k: {v} * exp({v}))) / {z})"


_PT = "substr(text, 1, 256)"
_AT = f"position('Table ' IN {_PT})"
_OFF = f"position(',' IN substr({_PT}, {_AT}))"
_WORD = "regexp_extract(" + _PT + ", 'QUESTION: (" + r"\p{L}" + "+)', 1)"
ORACLE["generate_standin"] = (
    "WITH p AS (" + _ehrsql("test") + "), "
    f"b AS (SELECT ord, id, text, floor((row_number() OVER (ORDER BY ord) - 1) / {BATCH_SIZE}) AS batch_id FROM p), "
    f"a AS (SELECT ord, id, batch_id, CASE WHEN {_AT} > 0 AND {_OFF} > 0 "
    f"THEN 'SELECT count(*) FROM ' || substr({_PT}, {_AT} + 6, {_OFF} - 7) || ';' "
    f"WHEN {_WORD} <> '' THEN 'SELECT count(*) FROM ' || {_WORD} || ';' ELSE 'SELECT 1;' END AS ans FROM b), "
    "s AS (SELECT *, length(ans) AS n, max(length(ans)) OVER (PARTITION BY batch_id) AS n_max, "
    f"list_transform(string_split(ans, ''), lambda c: {_tok_entropy('unicode(c)')}) AS ent FROM a) "
    "SELECT id, split_part(ans, ';', 1) AS sql, "
    f"round(CASE WHEN n < n_max THEN greatest(list_max(ent), {_tok_entropy('0')}) ELSE list_max(ent) END, 6) AS score "
    "FROM s")


# --- sources and sinks ---------------------------------------------------------
ORACLE["src_catalog"] = "SELECT * FROM (" + ORACLE["catalog_columns"] + ") WHERE db_id = 'Brand#1'"
ORACLE["src_pauq"] = _with(O.SAMPLES) + "SELECT id, db_id, question, query FROM samples"
ORACLE["src_questions"] = _with(O.LABELS) + "SELECT id, question FROM questions"
ORACLE["src_labels"] = _with(O.LABELS) + "SELECT id, sql FROM lbl"
ORACLE["snk_results"] = (
    "SELECT CAST(user_id AS VARCHAR) AS id, 'select ' || arg_max(event_type, event_id) AS sql, "
    "arg_max(value, event_id) AS score FROM events GROUP BY user_id")
ORACLE["snk_predictions"] = ("SELECT 'select ' || event_type AS sql, count(*) AS n, count(*) AS n_in_order "
                             "FROM events GROUP BY event_type")
ORACLE["snk_prompts"] = ORACLE["build_prompts_test"]
ORACLE["snk_names"] = (
    "WITH s AS (SELECT page_id, split_part(list_last(string_split(url, '/')), '.', 1) AS stem FROM pages) "
    "SELECT page_id, stem || '_inference_result.pkl' AS results_all, "
    "stem || '_inference_result_sql_predictions.txt' AS predictions_all, "
    "stem || '_one_batch_inference_result.pkl' AS results_one_batch, "
    "stem || '_one_batch_inference_result_one_batch_sql_predictions.txt' AS predictions_one_batch FROM s")
ORACLE["zip_outputs"] = ("SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS id, 'select ' || event_type AS sql, value AS score "
                         "FROM events")
ORACLE["labels_copartitioned"] = ORACLE["attach_labels"]
ORACLE["src_split_arrays"] = _with(O.SAMPLES) + (
    "SELECT row_number() OVER (ORDER BY ord) - 1 AS nth, id, db_id, question, query FROM samples")
ORACLE["src_corpus"] = f"SELECT id, text FROM ({ORACLE['build_prompts_test']})"
ORACLE["src_train_eval"] = (
    f"SELECT CASE WHEN d.lang = 'en' THEN 'eval' ELSE 'train' END AS split, p.id, p.text FROM ({ORACLE['build_prompts_train']}) p "
    "JOIN documents d ON p.ord = d.doc_id")


def _earliest(text: str, stops: list[str]) -> str:
    """How much of a text stays when it ends with the first stop it holds."""
    ends = ", ".join(f"nullif(position({O.lit(s)} IN {text}), 0) + {len(s) - 1}" for s in stops)
    return f"CAST(coalesce(least({ends}), length({text})) AS BIGINT)"


ORACLE["terminator_cut"] = (
    f"SELECT conv_id, turn, {_earliest('text', [fixed.END_OF_TURN, *fixed.TERMINATOR_TOKENS])} AS kept FROM conversations")
_MARK = (f"CASE lang WHEN 'en' THEN {O.lit(fixed.END_OF_TURN)} WHEN 'fr' THEN {O.lit(fixed.TERMINATOR_TOKENS[1])} "
         f"WHEN 'de' THEN {O.lit(fixed.TERMINATOR_TOKENS[2])} ELSE '' END")
ORACLE["stop_sequences"] = (
    f"WITH d AS (SELECT doc_id, replace(text, ' the ', {_MARK}) || '<|eot_id|' AS t FROM documents) "
    f"SELECT doc_id, {_earliest('t', [fixed.END_OF_TURN, *fixed.TERMINATOR_TOKENS[1:]])} AS kept FROM d")
ORACLE["template_default"] = (
    f"SELECT conv_id, {O.lit(fixed.BOS)} || string_agg({O.render_message('role', 'text')}, '' ORDER BY turn) "
    f"|| {O.lit(fixed.ASSISTANT_HEADER)} AS text FROM conversations GROUP BY conv_id")
ORACLE["template_chatml"] = (
    "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) "
    "|| '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id")
ORACLE["stream_last_by_id"] = ORACLE["last_by_id"]


# The templates of the stand-in hold one query block each, so every name bound
# to a table goes by token alone; nested blocks are hand-checked goldens.
def _alias_token(e: str) -> str:
    region = f"substr({e}, position('from ' IN {e}))"
    al = f"regexp_extract_all({region}, {O.lit(fixed.ALIAS_RE)}, 2)"
    tb = f"regexp_extract_all({region}, {O.lit(fixed.ALIAS_RE)}, 1)"
    return f"""array_to_string(list_filter(list_transform(regexp_extract_all({e}, {O.lit(fixed.TOKEN_RE)}), lambda x, i:
        CASE WHEN list_contains({al}, x) OR (x = 'as' AND list_contains({al}, regexp_extract_all({e}, {O.lit(fixed.TOKEN_RE)})[i + 1])) THEN NULL
             WHEN x[1] <> chr(39) AND contains(x, '.') AND list_contains({al}, split_part(x, '.', 1))
             THEN list_extract({tb}, list_position({al}, split_part(x, '.', 1))) || substr(x, position('.' IN x)) ELSE x END),
        lambda x: x IS NOT NULL), ' ')"""


_ctes, _last = O.normalize_ctes("part_sql", "sql", "id", upto="asc")
ORACLE["norm_alias_token"] = _with(O.PART_SQL, _ctes) + f"SELECT id, {_alias_token('sql')} AS sql FROM {_last}"
ORACLE["score_logits"] = (
    f"WITH {_STEPS}, made AS (SELECT vec_id, ent, array_to_string(list_transform(seq[4:], lambda i: substr(';abcdefg', i + 1, 1)), '') AS said, "
    "coalesce(list_position(seq[4:], 0), 0) AS p FROM ve), "
    "one AS (SELECT vec_id, CAST(vec_id % 97 AS VARCHAR) AS id, split_part(said, ';', 1) AS sql, "
    "round(list_max(CASE WHEN p = 0 THEN ent ELSE ent[1:p] END), 6) AS score FROM made) "
    "SELECT id, arg_max(sql, vec_id) AS sql, arg_max(score, vec_id) AS score FROM one GROUP BY id")
