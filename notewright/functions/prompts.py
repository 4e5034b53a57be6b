"""Prompts around a note: an instruction, the note's date, its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The instructions and date lines that models were trained on and are asked with, letter by letter.
TRAINING = (
    """Extract concepts from the following clinical note. Determine event time from note using this priority order:
  1. Explicit date in note → use exact date
  2. Calculable relative date → calculate from reference date
  3. Current observation/symptom → note date
  4. Historical event, date unclear → "unknown"
  5. Future plan → when documented (e.g. note date)
If date (year-mon-day) is incomplete, use only the known information, use 0000 or 00 for the rest parts.
When date is not available, determine if it is a current event or historical event. If current event, use the note date, otherwise use "unknown".

Note date (use this as the current event date): """,
    ".\n\n ",
)
FIRST_PASS = (
    """Extract concepts from the following clinical note. Determine event time from context. 
        If date (year-mon-day) is incomplete, use only the known information, use 0000 or 00 for the rest parts.
        When date is not available, determine if it is a current event or historical event. If current event, use the note date, otherwise use "unknown".

Note date (use this as the current event date): """,
    ".\n",
)
RETRY = (
    """Extract concepts from the following clinical note. Determine event time from context. 
If date (year-mon-day) is incomplete, use only the known information, use 0000 or 00 for the rest parts.
When date is not available, determine if it is a current event or historical event. If current event, use the note date, otherwise use "unknown".

Note date (use this as the current event date): """,
    ".\n\n ",
)
SHARDED = (
    """Extract concepts from the following clinical note.

Note date: """,
    ".\n",
)
STYLES = {"training": TRAINING, "first_pass": FIRST_PASS, "retry": RETRY, "sharded": SHARDED}


def prompt(style: str, date: Column, text: Column) -> Column:
    """The prompt of a style; null for a null text, and a null date reads None."""
    before, after = STYLES[style]
    return F.concat(F.lit(before), F.coalesce(date, F.lit("None")), F.lit(after), text)


def chat(family: str, user: Column, assistant: Column) -> Column:
    """One exchange as the model family's chat template renders it."""
    opening, answer, closing = TEMPLATES[family_of(family)]
    return F.concat(F.lit(opening), user, F.lit(closing + answer), assistant, F.lit(closing))


#: How a turn of the user and of the model opens, and how a turn closes.
TEMPLATES = {
    "im": ("<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"),
    "turn": ("<start_of_turn>user\n", "<start_of_turn>model\n", "<end_of_turn>\n"),
}


def family_of(model_name: str) -> str:
    """The template family of a model, by its name."""
    name = model_name.lower()
    if "qwen" in name or "lfm" in name:
        return "im"
    if "gemma" in name:
        return "turn"
    raise NotImplementedError(f"no response template for model {model_name}")


def response_template(model_name: str) -> str:
    """The text after which a model's answer starts."""
    return TEMPLATES[family_of(model_name)][1]
