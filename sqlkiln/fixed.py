"""Fixed values.

Everything in this module must stay exactly as written: prompts, chat
markers, whitespace classes and the token / clause patterns decide the bytes
of every prompt and every normalised query.  They are plain data, shared by
the Spark expressions and by the DuckDB oracle.
"""

# --- fixed values: system instruction (leading newline, two blanks before
# the end of the first line, trailing newline) ---------------------------
INSTRUCTION = (
    "\nYou are text-to-SQL assistant. You get QUESTION and DATABASE SCHEMA from user.  \n"
    "Generate only a correct SQL query in response:\n"
)

# --- fixed values: default chat template (public Llama-3 convention) -----
BOS = "<|begin_of_text|>"
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"
ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>\n\n"

# --- fixed values: chat templates as text (public conventions) -----------
LLAMA3_TEMPLATE = (
    "{% set loop_messages = messages %}{% for message in loop_messages %}"
    "{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n' + message['content'] | trim "
    "+ '<|eot_id|>' %}{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}"
    "{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\n\n' }}{% endif %}"
)
CHATML_TEMPLATE = (
    "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n' }}"
    "{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
)

# --- fixed values: extra generation terminators (besides eos and eot) ----
TERMINATOR_TOKENS = [";", "';", '";']

# --- fixed values: Python str.strip() whitespace, as a regex class body ----
# Written out because Java's (?U)\s misses \x1c-\x1f and RE2's \s is ASCII.
PY_WS_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
PY_STRIP_RE = rf"^[{PY_WS_CLASS}]+|[{PY_WS_CLASS}]+$"
# The same set as characters, for Spark's native trim(BOTH chars FROM s).
PY_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Python's Unicode \w, written so that Java and RE2 read it the same way.
WORD = r"[\p{L}\p{N}_]"
NOT_WS = rf"[^{PY_WS_CLASS}]"

# --- fixed values: SQL token contract (one token per match) --------------
# quoted literal ('' stands for a quote in it) | dotted name (t1.name, t1.*) | two-char operators | any
# other non-blank character.
TOKEN_RE = (
    rf"'(?:[^']|'')*'|{WORD}+(?:\.(?:{WORD}+|\*))*|<>|!=|>=|<=|==|\|\||{NOT_WS}"
)

# --- fixed values: ORDER BY key pattern that receives " asc" (Python re
# syntax, where \w and \S are Unicode-aware) -----------------------------
ORDER_BY_PATTERN = (
    r"order by (?:\w+ \( \S+ \)|\w+\.\w+|\w+)"
    r"(?: (?:\+|\-|\<|\<\=|\>|\>\=) (?:\w+ \( \S+ \)|\w+\.\w+|\w+))*"
)


def portable(pattern: str) -> str:
    r"""Python-syntax pattern -> one that Java and RE2 read the same way:
    Unicode ``\w`` / ``\S`` become explicit classes, and escaped operator
    characters lose the backslash RE2 does not accept."""
    out = pattern.replace(r"\w", WORD).replace(r"\S", NOT_WS)
    for ch in "<>=-":
        out = out.replace("\\" + ch, ch)
    return out


ORDER_BY_RE = portable(ORDER_BY_PATTERN)

# --- fixed values: table alias binding (FROM / JOIN / comma list) --------
# group 1 = table, group 2 = alias t1..t10; the trailing class replaces \b.
ALIAS_RE = (
    rf"(?:from|join|,) ([\p{{L}}\p{{N}}_.]+) (?:as )?(t(?:10|[1-9]))(?:[^\p{{L}}\p{{N}}_]|$)"
)
ALIASES = ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9", "t10"]

# --- fixed values: question cleaning -------------------------------------
CURLY_QUOTES = "‘’“”"

# --- fixed values: loss mask and training-step arithmetic ----------------
IGNORE_INDEX = -100
WARMUP_FRACTION = 0.03
