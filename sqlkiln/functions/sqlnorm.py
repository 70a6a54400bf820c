"""Gold-SQL normalisation stages as column expressions.

Each stage is a pure ``Column -> Column`` function.  ``NORMALIZE_STAGES``
lists them in the order the normalisation applies them; the DataFrame job in
``operators.corpus.normalize_sql`` materialises every stage as its own
projection so that no regex is evaluated twice.
"""

from pyspark.sql import Column, functions as F

from .. import fixed
from ._col import as_col
from .text import py_strip


def strip(c) -> Column:
    return py_strip(c)


def add_semicolon(c) -> Column:
    c = as_col(c)
    return F.when(c.endswith(";"), c).otherwise(F.concat(c, F.lit(";")))


def double_to_single(c) -> Column:
    return F.replace(as_col(c), F.lit('"'), F.lit("'"))


def token_spacing(c) -> Column:
    """Tokens of the SQL token contract joined by one blank."""
    return F.array_join(F.regexp_extract_all(as_col(c), F.lit(fixed.TOKEN_RE), F.lit(0)), " ")


def lower_outside_quotes(c) -> Column:
    """Lower-case every segment outside ``'...'``; each quote toggles."""
    parts = F.split(as_col(c), "'", -1)
    return F.array_join(
        F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(x)), "'"
    )


def add_asc(c) -> Column:
    """Append `` asc`` to each ORDER BY key match, everywhere it occurs, when
    the text has ``order by`` and neither ``asc`` nor ``desc``."""
    c = as_col(c)
    wanted = c.contains("order by") & ~c.contains("asc") & ~c.contains("desc")
    keys = F.regexp_extract_all(c, F.lit(fixed.ORDER_BY_RE), F.lit(0))
    folded = F.aggregate(keys, c, lambda acc, k: F.replace(acc, k, F.concat(k, F.lit(" asc"))))
    return F.when(wanted, folded).otherwise(c)


def alias_region(c) -> Column:
    """Text from the first ``from `` on: aliases are bound in FROM/JOIN only."""
    c = as_col(c)
    at = F.locate("from ", c)
    return F.when(at > 0, c.substr(at, F.length(c))).otherwise(F.lit(""))


def alias_bindings(region) -> Column:
    """``array<struct<a,t>>`` of (alias, table) pairs in text order."""
    region = as_col(region)
    aliases = F.regexp_extract_all(region, F.lit(fixed.ALIAS_RE), F.lit(2))
    tables = F.regexp_extract_all(region, F.lit(fixed.ALIAS_RE), F.lit(1))
    return F.zip_with(aliases, tables, lambda a, t: F.struct(a.alias("a"), t.alias("t")))


def apply_aliases(c, bindings) -> Column:
    """For t1..t10 in order: drop ``as tN `` and replace ``tN`` (as a
    substring) by its table; the last binding of an alias wins."""
    bindings = as_col(bindings)

    def step(acc, alias):
        table = F.aggregate(
            F.filter(bindings, lambda b: b["a"] == alias),
            F.lit(None).cast("string"),
            lambda _, b: b["t"],
        )
        dropped = F.replace(acc, F.concat(F.lit("as "), alias, F.lit(" ")), F.lit(""))
        return F.when(table.isNull(), acc).otherwise(F.replace(dropped, alias, table))

    # Only bound aliases are folded over, in the order t1..t10; most texts
    # bind none and pass through.
    bound = F.filter(F.array(*[F.lit(a) for a in fixed.ALIASES]), lambda a: F.exists(bindings, lambda b: b["a"] == a))
    return F.when(F.size(bindings) == 0, as_col(c)).otherwise(F.aggregate(bound, as_col(c), step))


def remove_table_alias(c) -> Column:
    c = as_col(c)
    return apply_aliases(c, alias_bindings(alias_region(c)))


def drop_tabs(c) -> Column:
    return F.replace(as_col(c), F.lit("\t"), F.lit(""))


# Stage order of the normalisation (strip runs twice in the original; once is
# the same).
NORMALIZE_STAGES = [
    ("strip", strip),
    ("semicolon", add_semicolon),
    ("quotes", double_to_single),
    ("tokens", token_spacing),
    ("lower", lower_outside_quotes),
    ("asc", add_asc),
    ("alias", remove_table_alias),
    ("tabs", drop_tabs),
]
