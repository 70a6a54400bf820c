"""Table aliases resolved by the structure of a query, token by token.

The default alias stage of the normalisation replaces ``t1`` .. ``t10`` as
substrings of the whole text, as the original does.  Here an alias belongs to
the query block that binds it: a sub-query in parentheses opens a block inside
the current one, and UNION, INTERSECT or EXCEPT begin a block beside it.  A
name is looked up in its own block first, then in the blocks around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import fixed

# The token contract; Python's \w is the word class of the contract.
TOKEN = re.compile(fixed.TOKEN_RE.replace(fixed.WORD, r"\w").replace(fixed.NOT_WS, f"[^{re.escape(fixed.PY_WS_CHARS)}]"))
SET_OPERATORS = ("union", "intersect", "except")
CLAUSE_ENDS = ("where", "group", "order", "having", "limit", "select", *SET_OPERATORS)
OWN, DERIVED = 1, 2


@dataclass
class Block:
    """One query block: the tables its aliases stand for (None: a derived
    table, which has no name to put in), and the block around it."""

    outer: Block | None
    tables: dict[str, str | None] = field(default_factory=dict)
    in_from: bool = False
    expects: bool = False  # a table may come next

    def find(self, alias: str) -> str | None:
        block = self
        while block is not None:
            if alias in block.tables:
                return block.tables[alias]
            block = block.outer
        return None


def _name(token: str) -> bool:
    return token[0] != "'" and (token[0].isalnum() or token[0] == "_")


def resolve_aliases(sql: str | None) -> str | None:
    """``sql`` (tokens apart by blanks, lower case outside literals) without
    its aliases ``t1`` .. ``t10``: the binding goes (``from a as t1`` becomes
    ``from a``) and every use, ``t1`` or ``t1.x``, names the table.

    A literal is never changed, nor a longer word such as ``t1x``.  The last
    binding of a block wins.  The alias of a sub-query stays and hides an
    outer one of the same name.  Unbalanced parentheses close what is open."""
    if sql is None:
        return None
    tokens = TOKEN.findall(sql)
    block_of: list[Block] = []
    dropped: set[int] = set()
    block = Block(None)
    stack: list[tuple[int, Block, bool]] = []  # (kind, block outside, expects there)
    i, n = 0, len(tokens)

    def bind(at: int, table: str | None) -> int:
        """Look for ``[as] tN`` at a place; returns the place after it."""
        named = at + (at < n and tokens[at] == "as")
        if named < n and tokens[named] in fixed.ALIASES:
            block.tables[tokens[named]] = table
            while len(block_of) <= named:
                block_of.append(block)
            if table is not None:
                dropped.update(range(at, named + 1))
            return named + 1
        return at

    while i < n:
        token = tokens[i]
        block_of.append(block)
        i += 1
        if token == "(":
            opens = i < n and tokens[i] in ("select", "with")
            stack.append((DERIVED if opens and block.expects else OWN if opens else 0, block, block.expects))
            if opens:
                block = Block(block)
            else:
                block.expects = block.expects and block.in_from
        elif token == ")":
            if stack:
                kind, outside, _ = stack.pop()
                block = outside
                block.expects = False
                if kind == DERIVED:
                    i = bind(i, None)
        elif token in SET_OPERATORS:
            block = Block(block.outer)
        elif token in ("from", "join"):
            block.in_from = block.expects = True
        elif token in CLAUSE_ENDS:
            block.in_from = block.expects = False
        elif token == ",":
            inside_call = bool(stack) and stack[-1][0] == 0 and stack[-1][1] is block
            block.expects = block.in_from and not inside_call
        elif block.expects and _name(token):
            block.expects = False
            i = bind(i, token)
    out = []
    for k, (token, owner) in enumerate(zip(tokens, block_of)):
        if k in dropped:
            continue
        head, dot, rest = token.partition(".")
        if head in fixed.ALIASES and token[0] != "'":
            table = owner.find(head)
            if table is not None:
                token = table + dot + rest
        out.append(token)
    return " ".join(out)
