"""Prompt construction: user task, chat array, chat template rendering,
phase filter and the one-batch limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.template import TextTemplate
from ..functions.text import py_strip

PHASES = ("train", "test")


@dataclass(frozen=True)
class ChatTemplate:
    """How a chat renders to text.  Content is stripped, as the usual Jinja
    ``| trim`` does."""

    bos: str = fixed.BOS
    header_start: str = fixed.HEADER_START
    header_end: str = fixed.HEADER_END
    end_of_turn: str = fixed.END_OF_TURN

    @property
    def generation_header(self) -> str:
        return f"{self.header_start}assistant{self.header_end}\n\n"

    def message(self, role: Column, content: Column) -> Column:
        """One rendered turn.  A turn without a role or content is an error:
        a NULL would otherwise vanish when the turns are joined."""
        text = F.concat(
            F.lit(self.header_start), role, F.lit(self.header_end + "\n\n"), py_strip(content), F.lit(self.end_of_turn)
        )
        return F.when(text.isNull(), F.raise_error(F.concat(
            F.lit("chat turn without content, role "), F.coalesce(role, F.lit("NULL"))))).otherwise(text)


DEFAULT_TEMPLATE = ChatTemplate()


def user_task(question, schema) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    s = F.col(schema) if isinstance(schema, str) else schema
    return F.concat(F.lit("QUESTION: "), q, F.lit("\nDATABASE SCHEMA: "), s, F.lit("\n"))


def with_user_task(df: DataFrame, question: str = "question", schema: str = "schema_str", out: str = "user_task"):
    return df.withColumn(out, user_task(question, schema))


def chat(phase: str, user: str = "user_task", answer: str = "answer") -> Column:
    """train: system, user, assistant; test: system, user."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}")
    msgs = [
        F.struct(F.lit("system").alias("role"), F.lit(fixed.INSTRUCTION).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(user).alias("content")),
    ]
    if phase == "train":
        msgs.append(F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content")))
    return F.array(*msgs)


def with_chat(df: DataFrame, phase: str, out: str = "chat", **kw) -> DataFrame:
    return df.withColumn(out, chat(phase, **kw))


# The default template as the text its tokenizer brings: the same bytes.
DEFAULT_TEXT_TEMPLATE = TextTemplate(fixed.LLAMA3_TEMPLATE, bos_token=fixed.BOS, eos_token=fixed.END_OF_TURN)
Template = ChatTemplate | TextTemplate


def render(chat_col, add_generation_prompt: bool, template: Template = DEFAULT_TEMPLATE) -> Column:
    """One chat array as text.  ``template`` is the built-in one or any chat
    template as text (``TextTemplate``)."""
    c = F.col(chat_col) if isinstance(chat_col, str) else chat_col
    if isinstance(template, TextTemplate):
        return template.render(c, add_generation_prompt)
    body = F.array_join(F.transform(c, lambda m: template.message(m["role"], m["content"])), "")
    tail = F.lit(template.generation_header if add_generation_prompt else "")
    return F.concat(F.lit(template.bos), body, tail)


def render_chat(df: DataFrame, chat_col: str = "chat", out: str = "text", add_generation_prompt: bool = False,
                template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    return df.withColumn(out, render(chat_col, add_generation_prompt, template))


def quarantine_incomplete(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows with a NULL in one of ``columns``): write the
    second, go on with the first."""
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    return df.filter(~lacks), df.filter(lacks)


def drop_unanswerable(df: DataFrame, phase: str, sql: str = "sql") -> DataFrame:
    """Train phase: drop questions labelled with the string ``'null'``; a JSON
    null label is quarantined too (the original crashes on it).  Test phase
    keeps everything."""
    if phase == "train":
        return df.filter(F.col(sql).isNotNull() & (F.col(sql) != F.lit("null")))
    return df


def first_batch(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """One-batch mode: the first ``n`` rows in file order, after filtering
    (a top-k: TakeOrderedAndProject, no global sort)."""
    return df.orderBy(ord_col).limit(n)


def select_prompts(df: DataFrame) -> DataFrame:
    return df.select("ord", "id", "text")


def render_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", add_generation_prompt: bool = False,
                         template: Template = DEFAULT_TEMPLATE, out: str = "text") -> DataFrame:
    """Long-form chats (one row per message) -> one rendered text per chat.
    Each message renders where it lies; only the rendered pieces are
    concatenated per chat, in turn order.  A template given as text may look
    at a message's place in its chat, so the chat is gathered first (its text
    is one output value in either case)."""
    if isinstance(template, TextTemplate):
        turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
        chats = df.groupBy(conv).agg(turns.alias("__turns"))
        return chats.select(conv, template.render(F.col("__turns"), add_generation_prompt).alias(out))
    msg = df.select(conv, turn, template.message(F.col(role), F.col(text)).alias("__m"))
    tail = F.lit(template.generation_header if add_generation_prompt else "")
    return msg.groupBy(conv).agg(
        F.concat(F.lit(template.bos), F.expr(f"listagg(__m, '') WITHIN GROUP (ORDER BY {turn})"), tail).alias(out)
    )
