"""The default token counter, as a Column and in Python; real tokenizers plug in with the same two forms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores, or one other visible character.
PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_PY = re.compile(r"\w+|[^\w \t\n\r\x0b\x0c]")  # of white space, only that of ASCII counts nothing, as in PATTERN
TURN_START, TURN_END, IMAGE_MARK, IMAGE_TOKEN = "<start_of_turn>", "<end_of_turn>", "<|image|>", "<start_of_image>"

TokenCounter = Callable[[Column], Column]


def count_tokens(text: Column | str) -> Column:
    """0 for blank text, else 1 (begin mark) plus the matches of PATTERN. Stays in code generation."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.regexp_count(F.coalesce(t, F.lit("")), F.lit(PATTERN))
    return F.when(n > 0, n + 1).otherwise(F.lit(0)).cast("long")


def count_tokens_py(text: str | None) -> int:
    n = len(_PY.findall(text or ""))
    return n + 1 if n else 0


def format_prompt(prompt: Column | str) -> Column:
    """One user turn, with image marks turned into image tokens."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.lit(f"{TURN_START}user\n"), F.replace(p, F.lit(IMAGE_MARK), F.lit(IMAGE_TOKEN)), F.lit(f"{TURN_END}\n{TURN_START}model\n"))


def format_prompt_py(prompt: str) -> str:
    return f"{TURN_START}user\n{prompt.replace(IMAGE_MARK, IMAGE_TOKEN)}{TURN_END}\n{TURN_START}model\n"


def count_prompt_tokens(prompt: Column | str, counter: TokenCounter = count_tokens) -> Column:
    return counter(format_prompt(prompt))


def placeholders_match(prompt: Column | str, images: Column) -> Column:
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.regexp_count(format_prompt(p), F.lit(IMAGE_TOKEN)) == images


def without_end_marks(tokens: Column) -> Column:
    """An array of generated tokens without its end marks."""
    return F.filter(tokens, lambda t: ~t.isin(TURN_END, "<eos>"))
