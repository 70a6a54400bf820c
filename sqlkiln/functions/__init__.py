"""Column expressions (JVM-side, no Python UDF) used by the operators."""

from .text import clean_question, postprocess_generated_sql, py_strip
from .arrays import (
    entropy,
    pad_ids,
    pad_mask,
    truncate_at_eos,
)

__all__ = [
    "clean_question",
    "postprocess_generated_sql",
    "py_strip",
    "entropy",
    "pad_ids",
    "pad_mask",
    "truncate_at_eos",
]
