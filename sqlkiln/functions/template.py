"""Chat templates as data: the template text that comes with a tokenizer,
compiled to one Spark expression over an array of ``{role, content}``.

The part of the template language that chat templates use is understood: text,
``{{ value }}``, ``{% for message in messages %}``, ``{% if %}`` / ``elif`` /
``else``, ``{% set %}``, white-space control, ``+`` and ``~``, comparisons,
``and`` / ``or`` / ``not``, ``loop.first`` / ``last`` / ``index`` / ``index0``,
``messages[0]``, and the filters ``trim``, ``upper`` and ``lower``.  Anything
else is a ``TemplateError`` when the template is compiled, never a wrong text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from .text import py_strip

TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
WORD = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\d+|[A-Za-z_]\w*|==|!=|[-+~|.()\[\]])", re.S)
FILTERS: dict[str, Callable[[Column], Column]] = {"trim": py_strip, "upper": F.upper, "lower": F.lower}
LOOP = {"first": lambda i, n: i == 0, "last": lambda i, n: i == n - 1, "index": lambda i, n: i + 1, "index0": lambda i, n: i}


class TemplateError(ValueError):
    """Template text outside the language above."""


@dataclass
class Messages:
    """An array of turns while a template is compiled."""

    column: Column


@dataclass
class Turn:
    """One turn: its fields are looked up by name."""

    column: Column

    def field(self, name: str) -> Column:
        if name not in ("role", "content"):
            raise TemplateError(f"a message has no field {name!r}")
        return self.column[name]


@dataclass
class Loop:
    at: Column
    size: Column


class _Expression:
    """Recursive descent over the words of one tag."""

    def __init__(self, text: str, names: dict[str, Any]):
        self.text, self.names, self.words, at = text, names, [], 0
        text = text.rstrip()
        while at < len(text):
            found = WORD.match(text, at)
            if found is None:
                raise TemplateError(f"cannot read {text[at:]!r} in {self.text!r}")
            self.words.append(found[1])
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, *wanted: str) -> str | None:
        word = self.peek()
        if word is None or (wanted and word not in wanted):
            return None
        self.at += 1
        return word

    def need(self, *wanted: str) -> str:
        word = self.take(*wanted)
        if word is None:
            raise TemplateError(f"expected {' or '.join(wanted) or 'a value'} in {self.text!r}")
        return word

    def whole(self) -> Any:
        value = self.disjunction()
        if self.peek() is not None:
            raise TemplateError(f"{self.peek()!r} is not understood in {self.text!r}")
        return value

    def disjunction(self) -> Any:
        value = self.conjunction()
        while self.take("or"):
            value = truth(value) | truth(self.conjunction())
        return value

    def conjunction(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = truth(value) & truth(self.negation())
        return value

    def negation(self) -> Any:
        return ~truth(self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        value = self.sum()
        while word := self.take("==", "!="):
            other = column(self.sum())
            value = column(value).eqNullSafe(other) if word == "==" else ~column(value).eqNullSafe(other)
        return value

    def sum(self) -> Any:
        value = self.filtered()
        while self.take("+", "~"):
            value = F.concat(column(value), column(self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.primary()
        while self.take("|"):
            name = self.need()
            if name not in FILTERS:
                raise TemplateError(f"filter {name!r} is not understood")
            value = FILTERS[name](column(value))
        return value

    def primary(self) -> Any:
        word = self.need()
        if word == "(":
            value = self.disjunction()
            self.need(")")
        elif word[0] in "'\"":
            value = F.lit(ast.literal_eval(word.replace("\n", "\\n")))
        elif word.isdigit():
            value = int(word)
        elif word in ("true", "True", "false", "False"):
            value = F.lit(word.lower() == "true")
        elif word in self.names:
            value = self.names[word]
        else:
            raise TemplateError(f"{word!r} is not known in {self.text!r}")
        while word := self.take(".", "["):
            value = self.member(value, word)
        return value

    def member(self, value: Any, word: str) -> Any:
        if word == ".":
            name = self.need()
        else:
            key = self.need()
            self.need("]")
            if isinstance(value, Messages) and key.isdigit():
                return Turn(F.get(value.column, F.lit(int(key))))
            if key[0] not in "'\"":
                raise TemplateError(f"[{key}] is not understood in {self.text!r}")
            name = ast.literal_eval(key)
        if isinstance(value, Turn):
            return value.field(name)
        if isinstance(value, Loop) and word == "." and name in LOOP:
            return LOOP[name](value.at, value.size)
        raise TemplateError(f"{name!r} is not understood in {self.text!r}")


def column(value: Any) -> Column:
    if isinstance(value, (Messages, Turn, Loop)):
        raise TemplateError("a message is not a text")
    return value if isinstance(value, Column) else F.lit(value)


def truth(value: Any) -> Column:
    """A condition: booleans as they are, a text is true when not empty."""
    c = column(value)
    return F.coalesce(F.when(c.cast("string").isin("", "false", "0"), False).when(c.isNotNull(), True), F.lit(False))


def pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text) of a template, kinds ``text``, ``value`` and ``block``.
    As usual for chat templates, a block tag swallows the line break after it
    and the blanks before it on its line; ``-`` swallows all white space on
    its side."""
    found: list[tuple[str, str]] = []
    at, eat, line = 0, False, False
    for tag in [*TAG.finditer(source), None]:
        text = source[at : tag.start()] if tag else source[at:]
        if eat:
            text = text.lstrip()
        elif line and text.startswith("\n"):
            text = text[1:]
        if tag is None:
            found.append(("text", text))
            return found
        body, kind = tag[0][2:-2], {"%": "block", "{": "value", "#": "note"}[tag[0][1]]
        if body.startswith("-"):
            text = text.rstrip()
        elif kind != "value":
            head, _, last = text.rpartition("\n")
            if not last.strip(" \t") and (at == 0 or "\n" in text):
                text = text[: len(text) - len(last)]
        found.append(("text", text))
        at, eat, line = tag.end(), body.endswith("-"), kind != "value"
        if kind != "note":
            found.append((kind, body.strip("-").strip()))
    return found


class _Compiler:
    def __init__(self, source: str):
        self.parts, self.at = pieces(source), 0

    def block(self, names: dict[str, Any], *ends: str) -> tuple[list[Column], str]:
        """Texts up to one of the ``ends``; ``set`` changes ``names``."""
        out: list[Column] = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if body:
                    out.append(F.lit(body))
            elif kind == "value":
                out.append(column(_Expression(body, names).whole()).cast("string"))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return out, body
                rest = body[len(word) :].strip()
                if word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"{body!r} is not understood")
                    names[name.strip()] = _Expression(value, names).whole()
                elif word == "if":
                    out.append(self.branch(rest, names))
                elif word == "for":
                    out.append(self.loop(rest, names))
                else:
                    raise TemplateError(f"{body!r} is not understood")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, ""

    def branch(self, condition: str, names: dict[str, Any]) -> Column:
        test = truth(_Expression(condition, names).whole())
        mine = dict(names)
        then, end = self.block(mine, "elif", "else", "endif")
        other, rest = dict(names), F.lit("")
        if end.startswith("elif"):
            rest = self.branch(end[len("elif") :], other)
        elif end == "else":
            texts, end = self.block(other, "endif")
            rest = joined(texts)
        for name in mine.keys() | other.keys():
            a, b = mine.get(name), other.get(name)
            if a is not b:
                if a is None or b is None:
                    names.pop(name, None)  # set in one branch only: not known after
                else:
                    names[name] = F.when(test, column(a)).otherwise(column(b))
            elif name not in names:
                names[name] = a
        return F.when(test, joined(then)).otherwise(rest)

    def loop(self, head: str, names: dict[str, Any]) -> Column:
        found = re.fullmatch(r"(\w+)\s+in\s+(\w+)", head)
        over = names.get(found[2]) if found else None
        if not isinstance(over, Messages):
            raise TemplateError(f"'for {head}' is not understood")
        begin, after = self.at, None

        def turn(m: Column, i: Column) -> Column:
            nonlocal after
            self.at = begin
            inner = names | {found[1]: Turn(m), "loop": Loop(i, F.size(over.column))}
            text = joined(self.block(inner, "endfor")[0])
            after = self.at
            said = F.coalesce(m["role"], F.lit("NULL"))
            return F.when(text.isNull(), F.raise_error(F.concat(F.lit("chat turn without content, role "), said))).otherwise(text)

        text = F.array_join(F.transform(over.column, turn), "")
        self.at = after
        return text


def joined(texts: list[Column]) -> Column:
    return F.concat(F.lit(""), *texts)


@dataclass(frozen=True)
class TextTemplate:
    """A chat template given as text, with its tokenizer's special tokens."""

    source: str
    bos_token: str = ""
    eos_token: str = ""

    def render(self, chat: Column, add_generation_prompt: bool) -> Column:
        """The text of a chat; a turn whose text comes out NULL is an error."""
        names = {"messages": Messages(chat), "add_generation_prompt": F.lit(add_generation_prompt),
                 "bos_token": F.lit(self.bos_token), "eos_token": F.lit(self.eos_token)}
        return joined(_Compiler(self.source).block(names)[0])
