"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
whole driver tables.  ``ORACLE`` (in ``sqlkiln.oracle_queries``) holds the
DuckDB SQL for the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog as C
from ..operators.corpus import clean_questions, normalize_sql, postprocess_sql
from ..operators.joins import attach_labels, attach_schema, attach_schema_const, unmatched
from ..operators.ordering import dense_positions, with_batch_id
from ..functions.template import TextTemplate
from ..operators.prompts import DEFAULT_TEXT_TEMPLATE, drop_unanswerable, first_batch, render_conversations
from .. import fixed
from ..operators import confidence as SC
from ..operators import tokens as TK
from ..operators.inference import ModelSpec, generate
from . import standins as S
from .prompts import ehrsql_prompts, pauq_prompts, read_corpus, train_eval_prompts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CONST_DB = "Brand#1"
BATCH_SIZE = 12       # inference batch of the local launcher
ONE_BATCH = 4         # default evaluation batch in one-batch mode


def query(fn):
    """Register under the function name; a trailing ``_q`` (used where the
    name would shadow an imported operator) is dropped."""
    name = fn.__name__[:-2] if fn.__name__.endswith("_q") else fn.__name__
    QUERIES[name] = fn
    return fn


def _catalog(spark, sf):
    return S.catalog_from_part(S.table(spark, sf, "part"))


def _schemas(spark, sf):
    return C.schema_strings(_catalog(spark, sf))


# --- catalog ---------------------------------------------------------------

@query
def catalog_columns(spark, sf):
    return C.catalog_columns(_catalog(spark, sf)).select("db_id", "tbl", "col", "col_type", "tbl_ord", "col_ord")


@query
def catalog_primary_keys(spark, sf):
    return C.catalog_primary_keys(_catalog(spark, sf)).select("db_id", "tbl", "col", "pk_ord")


@query
def catalog_foreign_keys(spark, sf):
    return C.catalog_foreign_keys(_catalog(spark, sf)).select("db_id", "tbl1", "col1", "tbl2", "col2", "fk_ord")


@query
def schema_strings(spark, sf):
    return _schemas(spark, sf)


@query
def schema_strings_grouped(spark, sf):
    """Same text through the per-part aggregates (table lines, key lists)."""
    return C.schema_strings_grouped(_catalog(spark, sf))


# --- questions and generated SQL -------------------------------------------

def raw_questions(documents: DataFrame) -> DataFrame:
    """Whole document texts with tabs, curly quotes and odd blanks added."""
    q = F.concat(
        F.lit("\t ‘"), F.replace(F.col("text"), F.lit("\n"), F.lit(" \n\t")), F.lit("’ “"), F.col("lang"),
        F.lit("” \n"),
    )
    return documents.select(S.doc_id_str(F.col("doc_id")).alias("id"), q.alias("question"))


@query
def clean_questions_q(spark, sf):
    return clean_questions(raw_questions(S.table(spark, sf, "documents")), "question")


@query
def postprocess_sql_q(spark, sf):
    d = S.table(spark, sf, "documents")
    x = d.select(S.doc_id_str(F.col("doc_id")).alias("id"), F.concat(F.col("text"), F.lit(";x")).alias("sql"))
    return postprocess_sql(x, "sql")


def _norm(upto):
    def run(spark, sf):
        return normalize_sql(S.part_sql(S.table(spark, sf, "part")), "sql", upto=upto)
    return run


for _stage in ("semicolon", "quotes", "tokens", "lower", "asc", "alias"):
    QUERIES[f"norm_{_stage}"] = _norm(_stage)


@query
def normalize_sql_q(spark, sf):
    return normalize_sql(S.part_sql(S.table(spark, sf, "part")), "sql")


# --- joins and filters -----------------------------------------------------

def _samples(spark, sf):
    return S.samples_from_documents(S.table(spark, sf, "documents"))


@query
def attach_schema_q(spark, sf):
    return attach_schema(_samples(spark, sf).select("id", "db_id"), _schemas(spark, sf))


@query
def attach_schema_const_q(spark, sf):
    q = S.questions_from_documents(S.table(spark, sf, "documents")).select("id")
    return attach_schema_const(q, _schemas(spark, sf), CONST_DB)


def _labels(spark, sf):
    return S.labels_from_labels(S.table(spark, sf, "labels"))


def _questions(spark, sf):
    return S.questions_from_documents(S.table(spark, sf, "documents"))


@query
def attach_labels_q(spark, sf):
    return attach_labels(_questions(spark, sf).select("id"), _labels(spark, sf), on_missing="drop")


@query
def missing_labels(spark, sf):
    return unmatched(_questions(spark, sf).select("id"), _labels(spark, sf), "id")


@query
def labels_quarantine(spark, sf):
    """What a strict label lookup would stop at, kept with its text size."""
    q = _questions(spark, sf).select("ord", "id", F.length("question").alias("n_chars"))
    return unmatched(q, _labels(spark, sf), "id")


@query
def drop_unanswerable_q(spark, sf):
    q = attach_labels(_questions(spark, sf).select("id"), _labels(spark, sf), on_missing="drop")
    return drop_unanswerable(q, "train", "sql")


# --- prompts ---------------------------------------------------------------

@query
def build_prompts_train(spark, sf):
    return pauq_prompts(_samples(spark, sf), _schemas(spark, sf), "train")


@query
def build_prompts_test(spark, sf):
    return pauq_prompts(_samples(spark, sf), _schemas(spark, sf), "test")


@query
def ehrsql_prompts_train(spark, sf):
    return ehrsql_prompts(_questions(spark, sf), _labels(spark, sf), _schemas(spark, sf), "train",
                          db_id=CONST_DB, on_missing="drop")


@query
def ehrsql_prompts_test(spark, sf):
    return ehrsql_prompts(_questions(spark, sf), _labels(spark, sf), _schemas(spark, sf), "test",
                          db_id=CONST_DB, on_missing="drop")


@query
def chat_render(spark, sf):
    return render_conversations(S.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query
def first_batch_q(spark, sf):
    return ehrsql_prompts(_questions(spark, sf), _labels(spark, sf), _schemas(spark, sf), "train", db_id=CONST_DB,
                          on_missing="drop", one_batch=ONE_BATCH)


@query
def batch_ids(spark, sf):
    return with_batch_id(ehrsql_prompts_train(spark, sf).select("ord", "id"), BATCH_SIZE)


# --- tokens ----------------------------------------------------------------

MAX_SEQ = 256          # option default of the original launcher
PROFILE_LIMIT = 1024   # limit of the original length profile
TRAIN_BS, TRAIN_GAS, TRAIN_EPOCHS = 1, 17, 3.0   # option defaults
PAD_ID = 0
TRAIN_LEN = 3072       # a third of the stand-in prompts have their header beyond it


def _doc_tokens(spark, sf, max_len=None):
    d = S.table(spark, sf, "documents").select(S.doc_id_str(F.col("doc_id")).alias("id"), "source", "text")
    return TK.tokenize(d, "text", "input_ids", max_len=max_len)


def _doc_max_len(spark, sf):
    d = S.table(spark, sf, "documents").select("text")
    return TK.max_length(TK.count_tokens(d, "text", "n"), "n", MAX_SEQ)


def _ints(c):
    return F.array_join(F.col(c), ",")


@query
def tokenize_codepoints(spark, sf):
    t = _doc_tokens(spark, sf)
    ids = F.col("input_ids")
    return t.select(
        "id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("cp_sum"),
        F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"),
                    lambda a, x: a + x).alias("cp_wsum"),
    )


@query
def truncate(spark, sf):
    t = _doc_tokens(spark, sf, MAX_SEQ)
    return t.select("id", F.size("input_ids").cast("long").alias("n_tokens"), _ints("input_ids").alias("input_ids"))


def _pad(side):
    def run(spark, sf):
        t = _doc_tokens(spark, sf, MAX_SEQ)
        longest = _doc_max_len(spark, sf).first()["max_len"] or 0
        p = TK.pad(t.select("id", "input_ids"), "input_ids", PAD_ID, side, longest)
        return p.select("id", _ints("input_ids").alias("input_ids"), _ints("attention_mask").alias("attention_mask"))
    return run


QUERIES["pad_left"] = _pad("left")
QUERIES["pad_right"] = _pad("right")


@query
def length_profile(spark, sf):
    d = S.table(spark, sf, "documents").select("source", "text")
    return TK.length_profile(TK.count_tokens(d, "text", "n"), "n", PROFILE_LIMIT, by=["source"]).select(
        "source", "n_rows", "n_at_limit",
        F.round("mean_len_compat", 6).alias("mean_len_compat"), F.round("mean_len", 6).alias("mean_len"))


@query
def step_budget(spark, sf):
    d = S.table(spark, sf, "documents").select("source")
    return TK.step_budget(d, TRAIN_BS, TRAIN_GAS, TRAIN_EPOCHS, by=["source"])


@query
def roundtrip_failures(spark, sf):
    d = S.table(spark, sf, "documents").select("source", "text")
    return TK.roundtrip_failures(d, "text", PROFILE_LIMIT, by=["source"])


def header_ids() -> list[int]:
    return [ord(c) for c in fixed.ASSISTANT_HEADER]


@query
def completion_labels(spark, sf):
    lab = TK.tokenize_with_labels(build_prompts_train(spark, sf), "text", fixed.ASSISTANT_HEADER)
    kept = F.array_remove("labels", F.lit(fixed.IGNORE_INDEX))
    return lab.select(
        "id", F.size("input_ids").cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_labels"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query
def train_tokens(spark, sf):
    """The training token set: cut at the launcher's limit, so that the
    response header may lie beyond it, padded on the right, and masked."""
    lab = TK.tokenize_with_labels(build_prompts_train(spark, sf), "text", fixed.ASSISTANT_HEADER, pad_id=PAD_ID,
                                  max_len=TRAIN_LEN, pad_to=TRAIN_LEN)
    kept = F.array_remove("labels", F.lit(fixed.IGNORE_INDEX))
    return lab.select(
        "id", F.size("input_ids").cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_labels"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


# --- confidence ------------------------------------------------------------

@query
def step_entropy(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return SC.step_entropy(e, "embedding", "entropy").select("vec_id", F.round("entropy", 6).alias("entropy"))


@query
def step_entropy_long(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "logit"))
    h = SC.step_entropy_long(e.withColumn("logit", F.col("logit").cast("double")), ["vec_id"], "logit")
    return h.select("vec_id", F.round("entropy", 6).alias("entropy"))


def _generation_log(spark, sf):
    """events as generation steps: one sequence per user, steps by time,
    ``value`` = step score, an ``error`` event = end of sequence."""
    ev = S.table(spark, sf, "events")
    return ev.select("user_id", "event_id", "ts", "value", (F.col("event_type") == "error").alias("is_eos"))


@query
def truncate_scores(spark, sf):
    kept = SC.truncate_scores_long(_generation_log(spark, sf), ["user_id"], "ts", "is_eos")
    return kept.select("user_id", "event_id", "value")


@query
def confidence(spark, sf):
    kept = SC.truncate_scores_long(_generation_log(spark, sf), ["user_id"], "ts", "is_eos")
    return SC.confidence_long(kept, ["user_id"], "value")


@query
def last_by_id(spark, sf):
    ev = S.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return SC.last_by_id(ev, "user_id", "event_id", ["event_id", "event_type", "value"])


@query
def union_batches(spark, sf):
    """Outputs of two separate runs appended: English documents, then the rest."""
    d = S.table(spark, sf, "documents")
    first = S.questions_from_documents(d.filter(F.col("lang") == "en")).select("ord", "id")
    rest = S.questions_from_documents(d.filter(~F.col("lang").eqNullSafe("en"))).select("ord", "id")
    return first.unionByName(rest)


# --- generation (stand-in model) -------------------------------------------


@query
def generate_standin(spark, sf):
    """Test prompts -> stand-in generator -> (id, sql, score), last id wins:
    batching, truncation, in-worker entropy, EOS cut and post-processing."""
    prompts = ehrsql_prompts_test(spark, sf)
    scored = generate(prompts, ModelSpec("lookup"), batch_size=BATCH_SIZE, max_seq_length=MAX_SEQ)
    return SC.results(scored).select("id", "sql", F.round("score", 6).alias("score"))


# --- streaming -------------------------------------------------------------

@query
def stream_prompts_test(spark, sf):
    """Test prompts built on a file stream of documents; equals the batch
    ``build_prompts_test``."""
    from ..streaming.prompts import read_table_stream, run_to_table, stream_prompts

    docs = read_table_stream(spark, sf, "documents")
    return run_to_table(stream_prompts(S.samples_from_documents(docs), _schemas(spark, sf), "test"))


# --- rendering parts, counts, array-form scoring ------------------------------

@query
def table_lines(spark, sf):
    """CAT-7 alone: the table lines of each database."""
    return C.render_tables(C.catalog_columns(_catalog(spark, sf)))


@query
def fk_strings(spark, sf):
    """CAT-8 alone (databases with keys; the rest render as ``[]``)."""
    return C.render_foreign_keys(C.catalog_foreign_keys(_catalog(spark, sf)))


@query
def pk_strings(spark, sf):
    """CAT-9 alone."""
    return C.render_primary_keys(C.catalog_primary_keys(_catalog(spark, sf)))


@query
def max_len(spark, sf):
    """AGG-3: the padding target of the truncated document tokens."""
    return _doc_max_len(spark, sf)


@query
def prompt_counts(spark, sf):
    """AGG-5: rows per phase of the labelled corpus."""
    q = attach_labels(_questions(spark, sf).select("id"), _labels(spark, sf), on_missing="drop")
    n = q.agg(F.count_if(F.col("sql").isNotNull() & (F.col("sql") != "null")).alias("train"), F.count(F.lit(1)).alias("test"))
    return n.unpivot([], ["train", "test"], "split", "n_rows")


EOS_STANDIN = 0
VOCAB = 8


def _vec_steps(spark, sf):
    """embeddings as generation records: every 8 values are the logits of
    one step; the emitted id of a step is its arg-max, EOS when that is 0;
    the sequence is a 3-token prompt followed by the emitted ids."""
    e = S.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / VOCAB).cast("int") - 1), lambda s: F.slice("v", s * VOCAB + 1, VOCAB))
    e = e.select("vec_id", steps.alias("step_logits"))
    argmax = F.transform("step_logits", lambda l_: F.array_position(l_, F.array_max(l_)) - 1)
    # The prompt part is left-padded with EOS, as generation pads it.
    prompt = F.array(F.lit(EOS_STANDIN), F.lit(EOS_STANDIN), F.lit(7))
    return e.select("vec_id", "step_logits", F.concat(prompt, argmax.cast("array<int>")).alias("seq"),
                    F.lit(3).alias("input_len"))


@query
def step_entropies(spark, sf):
    """SCR-1 over the steps of each record (nested arrays)."""
    x = SC.step_entropies(_vec_steps(spark, sf), "step_logits", "ent")
    return x.select("vec_id", F.array_join(F.transform("ent", lambda h: F.format_number(h, 6)), ",").alias("entropies"))


def _array_scores(mode):
    def run(spark, sf):
        x = SC.step_entropies(_vec_steps(spark, sf), "step_logits", "scores")
        x = SC.confidence(SC.truncate_scores(x, "seq", "scores", EOS_STANDIN, mode), "scores", "score")
        return x.select("vec_id", F.size("scores").cast("long").alias("n_steps"), F.round("score", 6).alias("score"))
    return run


QUERIES["truncate_scores_array"] = _array_scores("aligned")
QUERIES["truncate_scores_compat"] = _array_scores("compat")


@query
def strip_prompt_q(spark, sf):
    """INF-2: a user turn is the prompt, the next assistant turn the output;
    the output ids are cut back off the concatenated sequence."""
    from ..operators.inference import strip_prompt

    c = S.table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = u.join(a, ["conv_id", "turn"])
    p = TK.tokenize(TK.tokenize(pairs, "prompt", "p_ids"), "answer", "a_ids")
    seq = p.select("conv_id", "turn", F.concat("p_ids", "a_ids").alias("seq"), F.size("p_ids").alias("input_len"))
    g = strip_prompt(seq, "seq", "input_len", "gen_ids")
    return g.select("conv_id", "turn", F.size("gen_ids").cast("long").alias("n_gen"),
                    F.aggregate("gen_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("gen_sum"))



# --- sources and sinks: written in the input shape, read back -------------------

def _written(spark, name, write):
    from ..session import shared_dir

    path = shared_dir(spark, name)
    write(path)
    return path


@query
def src_catalog(spark, sf):
    """SRC-1 and CAT-6: a JSON catalog, flattened again for one database."""
    from ..sources import json_sources, sinks

    empty = F.array().cast("array<string>")
    cat = _catalog(spark, sf).withColumn("table_names", empty).withColumn(
        "column_names", F.array().cast("array<array<string>>"))
    path = _written(spark, "src-catalog", lambda p: sinks.write_json_arrays(cat, p, 5, "db_id"))
    cols = C.catalog_columns(C.filter_db(json_sources.read_catalog(spark, path), CONST_DB))
    return cols.select("db_id", "tbl", "col", "col_type", "tbl_ord", "col_ord")


@query
def src_pauq(spark, sf):
    from ..sources import json_sources, sinks

    path = _written(spark, "src-pauq", lambda p: sinks.write_json_arrays(_samples(spark, sf), p))
    return json_sources.read_pauq(spark, path).select("id", "db_id", "question", "query")


@query
def src_questions(spark, sf):
    from ..sources import json_sources, sinks

    root = _written(spark, "src-questions", lambda p: sinks.write_json_arrays(_questions(spark, sf), f"{p}/data.json"))
    return json_sources.read_ehrsql_questions(spark, root).select("id", "question")


@query
def src_labels(spark, sf):
    from ..sources import json_sources, sinks

    root = _written(spark, "src-labels", lambda p: sinks.write_json_objects(_labels(spark, sf), f"{p}/label.json", "id", "sql"))
    return json_sources.read_ehrsql_labels(spark, root)


def _scored(spark, sf):
    """events as scored predictions: the last event of a user wins."""
    ev = S.table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("id"),
                     F.concat(F.lit("select "), F.col("event_type")).alias("sql"), F.col("value").alias("score"))


@query
def snk_results(spark, sf):
    from ..sources import sinks

    path = _written(spark, "snk-results", lambda p: sinks.write_results(_scored(spark, sf), p))
    return spark.read.parquet(path)


@query
def snk_predictions(spark, sf):
    """SNK-3: line counts by content, and how many lines hold the statement
    whose place in the data set is the line's number."""
    from ..sources import sinks

    path = _written(spark, "snk-predictions", lambda p: sinks.write_predictions(_scored(spark, sf), p))
    due = dense_positions(_scored(spark, sf).select("ord", F.col("sql").alias("due")), "ord", "line").select("line", "due")
    met = sinks.read_predictions(spark, path).join(due, "line", "left")
    return met.groupBy("sql").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sql") == F.col("due")).alias("n_in_order"))


@query
def terminator_cut(spark, sf):
    """FLT-4: where a generation over each conversation text would stop: at
    the end of the first terminator it completes, of one id or of several."""
    from ..operators.inference import cut_at_stops, eos_of, terminators

    tok = TK.CODEPOINT.load()
    c = TK.tokenize(S.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", "ids")
    return cut_at_stops(c, "ids", terminators(tok, eos_of(tok))).select("conv_id", "turn", "kept")


@query
def norm_alias_token(spark, sf):
    """NRM-7/8 by query block and token instead of by substring."""
    return normalize_sql(S.part_sql(S.table(spark, sf, "part")), "sql", upto="alias", alias_mode="token")


@query
def snk_prompts(spark, sf):
    """SNK-1: prompts written in one pass that commits only if every sample
    found its schema, and read back."""
    from pyspark.sql import Observation

    from ..sources import sinks

    check = Observation()
    made = pauq_prompts(_samples(spark, sf), _schemas(spark, sf), "test", on_missing=check)
    path = _written(spark, "snk-prompts", lambda p: sinks.write_checked(made, p, [check]))
    return spark.read.parquet(path)


@query
def snk_names(spark, sf):
    """SNK-4: the output names of every page address as a test path."""
    from ..sources.sinks import output_name_column

    pages = S.table(spark, sf, "pages")
    names = [output_name_column(F.col("url"), one, kind).alias(f"{kind}_{'one_batch' if one else 'all'}")
             for one in (False, True) for kind in ("results", "predictions")]
    return pages.select("page_id", *names)


@query
def zip_outputs_q(spark, sf):
    """JN-4: ids, statements and scores of three runs, put side by side."""
    from ..operators.joins import zip_outputs

    scored = _scored(spark, sf)
    return zip_outputs(scored.select("ord", "id"), scored.select("ord", "sql"), scored.select("ord", "score"))


@query
def labels_copartitioned(spark, sf):
    """JN-3 over tables stored bucketed by id: no shuffle in the join."""
    import uuid

    from ..operators.joins import write_copartitioned
    from ..session import shared_dir

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = uuid.uuid4().hex
    q = write_copartitioned(_questions(spark, sf).select("id"), f"questions_{run}", shared_dir(spark, "questions"), "id", buckets)
    lab = write_copartitioned(_labels(spark, sf), f"labels_{run}", shared_dir(spark, "labels"), "id", buckets)
    return attach_labels(q, lab, on_missing="drop")


@query
def src_split_arrays(spark, sf):
    """SRC-2 over array files as large as their tasks made them, each read in
    many tasks; ``nth`` is the place by ``ord`` among all samples."""
    from ..sources import json_sources, sinks

    path = _written(spark, "src-split", lambda p: sinks.write_json_parts(_samples(spark, sf), p))
    return dense_positions(json_sources.read_pauq(spark, path), "ord", "nth").drop("ord")


def _input_files(spark, sf):
    """The catalog as a file in the input shape, and a writer for samples."""
    from ..sources import sinks

    cat = _catalog(spark, sf).withColumn("table_names", F.array().cast("array<string>")).withColumn(
        "column_names", F.array().cast("array<array<string>>"))
    tables = _written(spark, "src-tables", lambda p: sinks.write_json_arrays(cat, p, 5, "db_id"))
    return tables, lambda rows: _written(spark, "src-samples", lambda p: sinks.write_json_arrays(rows, p))


@query
def src_corpus(spark, sf):
    """SRC-5, PRJ-5: data set dispatch over files in the input shape."""
    tables, write = _input_files(spark, sf)
    return read_corpus(spark, "pauq", write(_samples(spark, sf)), tables, "test").select("id", "text")


@query
def src_train_eval(spark, sf):
    """SRC-6: a training and an evaluation path; English samples evaluate."""
    samples = _samples(spark, sf)
    english = S.table(spark, sf, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("ord"))
    tables, write = _input_files(spark, sf)
    train, test = write(samples.join(english, "ord", "left_anti")), write(samples.join(english, "ord", "left_semi"))
    return train_eval_prompts(spark, "pauq", train, test, tables).select("split", "id", "text")


@query
def stop_sequences(spark, sf):
    """FLT-4 with several ids a stop: documents end at an end-of-turn marker
    or a quoted statement end, put into the text by its language."""
    from ..operators.inference import cut_at_stops, terminators

    tok = TK.CODEPOINT.load()
    marks = F.when(F.col("lang") == "en", fixed.END_OF_TURN).when(F.col("lang") == "fr", fixed.TERMINATOR_TOKENS[1]).when(
        F.col("lang") == "de", fixed.TERMINATOR_TOKENS[2]).otherwise("")
    text = F.concat(F.replace("text", F.lit(" the "), marks), F.lit("<|eot_id|"))
    d = S.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    stops = [s for s in terminators(tok, 0) if len(s) > 1]
    return cut_at_stops(TK.tokenize(d, "text", "ids"), "ids", stops).select("doc_id", "kept")


# --- templates as text, results on a stream ------------------------------------

def _template(template):
    def run(spark, sf):
        return render_conversations(S.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", True, template)
    return run


QUERIES["template_default"] = _template(DEFAULT_TEXT_TEMPLATE)
QUERIES["template_chatml"] = _template(TextTemplate(fixed.CHATML_TEMPLATE))


@query
def stream_last_by_id(spark, sf):
    """AGG-7, SNK-2 on a stream of scored predictions, replayed once: the
    second run has its own checkpoint and sees every batch again."""
    from ..session import shared_dir
    from ..streaming.prompts import read_table_stream
    from ..streaming.results import read_last, stream_last_by_id

    ev = read_table_stream(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    out = shared_dir(spark, "stream-results")
    for _ in range(2):
        stream_last_by_id(ev, out, shared_dir(spark, "stream-ckpt"), "user_id", "event_id", ["event_type", "value"])
    return read_last(spark, out, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query
def score_logits_q(spark, sf):
    """INF-2, SCR-1..4, TXT-2, AGG-7 over a table of logits: embeddings as
    steps, their likeliest words spelled in letters, ``;`` as the end."""
    from .scoring import score_logits

    letters = F.array(*[F.lit(ord(c)) for c in ";abcdefg"])
    steps = _vec_steps(spark, sf)
    spelled = F.transform("seq", lambda i: F.element_at(letters, i + 1))
    x = steps.select(F.col("vec_id").alias("ord"), (F.col("vec_id") % 97).cast("string").alias("id"), spelled.alias("seq"),
                     "input_len", "step_logits")
    return score_logits(x, ord(";")).select("id", "sql", F.round("score", 6).alias("score"))
