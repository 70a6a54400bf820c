"""String expressions for questions and generated SQL."""

from pyspark.sql import Column, functions as F

from .. import fixed
from ._col import as_col


def py_strip(c) -> Column:
    """Python ``str.strip()``: plain ``trim`` only removes U+0020, so trim the
    explicit whitespace set (native, no regex)."""
    return F.btrim(as_col(c), F.lit(fixed.PY_WS_CHARS))


def clean_question(c) -> Column:
    """Curly quotes become ``'``, tabs go, the ends are stripped, then every
    newline is deleted (no blank is left in its place).  Literal replaces are
    cheaper than ``translate`` on long texts."""
    x = as_col(c)
    for q in fixed.CURLY_QUOTES:
        x = F.replace(x, F.lit(q), F.lit("'"))
    x = F.replace(x, F.lit("\t"), F.lit(""))
    return F.replace(py_strip(x), F.lit("\n"), F.lit(""))


def postprocess_generated_sql(c) -> Column:
    """Delete newlines, keep the text before the first ``;``."""
    return F.substring_index(F.replace(as_col(c), F.lit("\n"), F.lit("")), ";", 1)
