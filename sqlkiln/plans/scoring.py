"""Inference and scoring end to end: prompts -> generation -> confidence ->
results and prediction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.confidence import confidence, results, step_entropies, truncate_scores
from ..operators.corpus import postprocess_sql
from ..operators.inference import ModelSpec, generate, strip_prompt
from ..operators.tokens import CODEPOINT, TokenizerSpec, decode
from ..sources.sinks import output_name, write_predictions, write_results


def score_prompts(prompts: DataFrame, model: ModelSpec, tokenizer: TokenizerSpec = CODEPOINT, **kw) -> DataFrame:
    """(ord, id, text) -> (ord, id, batch_id, sql, entropies, score)."""
    return generate(prompts, model, tokenizer, **kw)


def score_logits(steps: DataFrame, eos_id: int, tokenizer: TokenizerSpec = CODEPOINT, mode: str = "aligned") -> DataFrame:
    """Generations that are already there, scored: ``(ord, id, seq, input_len,
    step_logits)``, ids of prompt and output and the logits of every output
    step, to ``(id, sql, score)``, last id wins.  Entropies, the cut at the
    end of sequence and the maximum are column expressions; only decoding
    runs in Python."""
    scored = truncate_scores(step_entropies(steps, "step_logits", "scores"), "seq", "scores", eos_id, mode)
    scored = strip_prompt(confidence(scored, "scores", "score"), "seq", "input_len", "gen_ids")
    said = decode(scored.select("ord", "id", "gen_ids", "score"), "gen_ids", "raw_sql", tokenizer, skip_special_tokens=True)
    return results(postprocess_sql(said, "raw_sql", "sql")).select("id", "sql", "score")


def infer_and_write(prompts: DataFrame, model: ModelSpec, out_dir: str, test_path: str, *, one_batch: bool = False,
                    tokenizer: TokenizerSpec = CODEPOINT, **kw) -> DataFrame:
    """Run generation once, persist it in the shared folder, then write the
    result table (last id wins) and the prediction lines (all rows, in
    order).  Returns the scored rows."""
    from ..session import materialize

    scored = materialize(generate(prompts, model, tokenizer, **kw))
    write_results(scored, f"{out_dir.rstrip('/')}/{output_name(test_path, one_batch, 'results')}")
    write_predictions(scored, f"{out_dir.rstrip('/')}/{output_name(test_path, one_batch, 'predictions')}")
    return scored
