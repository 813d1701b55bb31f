"""Prompt and conversation operators (E1–E9), job ``render``.

Messages are ``array<struct<role, content>>`` (wide form) or rows of
``conversations(conv_id, turn, role, text)`` (long form); both forms are
supported and the long form never gathers more than one conversation per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_, py_strip

# Prompt wording of the three datasets.
SFT_INSTRUCTION = "Napraw literówki w poniższym tekście. Niczego nie dodawaj, niczego nie pomijaj. Zwróć tylko poprawiony tekst: "
SFT_MARKER = "Napraw literówki"
SHORT_PROMPT = "Napraw literówki w poniższym tekście:\n\n{text}"
REASONING_PROMPT = (
    "Napraw literówki w poniższym tekście. \n\n"
    "Najpierw w znacznikach <think></think> opisz jakie błędy zauważyłeś, a następnie podaj poprawiony tekst "
    "w znacznikach <answer></answer>.\n\n"
    "Tekst z błędami:\n`{text}`\n"
)
TASK = "typo"

# Chat-template delimiters are parameters: model templates are not part of the
# reference. The default is the public ChatML layout.
CHATML = {"open": "<|im_start|>{role}\n", "close": "<|im_end|>\n", "generation": "<|im_start|>assistant\n"}


def _fill(template: str, text: Column) -> Column:
    before, after = template.split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_record(pairs: DataFrame, correct: str = "correct", typos: str = "typos", task: str = TASK) -> DataFrame:
    """user = instruction + typo text in backticks; assistant = correct text."""
    user = F.concat(F.lit(SFT_INSTRUCTION + "`"), F.col(typos), F.lit("`"))
    msgs = F.array(message("user", user), message("assistant", F.col(correct)))
    keep = [c for c in pairs.columns if c not in (correct, typos)]
    return pairs.select(*keep, msgs.alias("messages"), F.lit(task).alias("task"))


def short_prompt(typos: Column | str) -> Column:
    """Instruction, blank line, text."""
    return _fill(SHORT_PROMPT, col_(typos))


def reasoning_prompt(typos: Column | str) -> Column:
    """Reasoning instruction with the text in backticks and a final newline."""
    return _fill(REASONING_PROMPT, col_(typos))


def render_template(messages: Column, template: dict[str, str] = CHATML, generation: bool = True) -> Column:
    """Flatten messages to one string (``generation`` appends the marker)."""
    open_before, open_after = template["open"].split("{role}")
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(open_before), m["role"], F.lit(open_after), m["content"], F.lit(template["close"]))), "")
    return F.concat(body, F.lit(template["generation"])) if generation else body


def render_conversations(conv: DataFrame, template: dict[str, str] = CHATML, generation: bool = True,
                         drop_last: bool = False) -> DataFrame:
    """E4 on the long form: one rendered string per conversation, turns in order.

    ``drop_last`` leaves out each conversation's last turn (E6); one with a
    single turn renders as no messages, so it keeps its row."""
    open_before, open_after = template["open"].split("{role}")
    piece = F.concat(F.lit(open_before), F.col("role"), F.lit(open_after), F.coalesce(F.col("text"), F.lit("")),
                     F.lit(template["close"]))
    per_conv = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", piece.alias("p")))).alias("ps"))
    turns = F.slice("ps", 1, F.size("ps") - 1) if drop_last else F.col("ps")
    text = F.array_join(F.transform(turns, lambda x: x["p"]), "")
    if generation:
        text = F.concat(text, F.lit(template["generation"]))
    return per_conv.select("conv_id", text.alias("rendered"))


def nth_of_role(messages: Column, role: str, n: int, strict: bool = False) -> Column:
    """E5 (wide): content of the n-th (0-based) message with ``role``; null if
    absent, or an error in ``strict`` mode (ANSI ``element_at``)."""
    sel = F.filter(messages, lambda m: m["role"] == role)
    if strict:
        return F.element_at(sel, n + 1)["content"]
    return F.get(sel, n)["content"]


def nth_of_role_long(conv: DataFrame, role: str, n: int) -> DataFrame:
    """E5 (long): the n-th message of ``role`` per conversation."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return (conv.filter(F.col("role") == role).withColumn("_k", F.row_number().over(w))
            .filter(F.col("_k") == n + 1).drop("_k"))


def drop_last_long(conv: DataFrame) -> DataFrame:
    """E6 (long): every turn but the last of each conversation."""
    w = Window.partitionBy("conv_id")
    return conv.withColumn("_last", F.max("turn").over(w)).filter(F.col("turn") < F.col("_last")).drop("_last")


def backtick_payload(user_msg: Column | str) -> Column:
    """With the instruction marker and a backtick present, the second
    backtick-separated field (or '' with fewer than two backticks); otherwise
    the whole message."""
    m = col_(user_msg)
    ticks = F.length(m) - F.length(F.replace(m, F.lit("`"), F.lit("")))
    return (
        F.when((F.instr(m, SFT_MARKER) > 0) & (F.instr(m, "`") > 0),
               F.when(ticks >= 2, F.split_part(m, F.lit("`"), F.lit(2))).otherwise(F.lit("")))
        .otherwise(m)
    )


def strip_prefix(generated: Column | str, prompt: Column | str) -> Column:
    """``generated[len(prompt):].strip()`` — by length, not by match."""
    g, p = col_(generated), col_(prompt)
    return py_strip(F.substring(g, F.length(p) + 1, F.greatest(F.length(g) - F.length(p), F.lit(0))))


def prompt_records(pairs: DataFrame, kind: str = "short", correct: str = "correct", typos: str = "typos",
                   template: dict[str, str] = CHATML) -> DataFrame:
    """M5: ``(prompt, correct_text, typo_text)`` with the chat template applied."""
    build = short_prompt if kind == "short" else reasoning_prompt
    msgs = F.array(message("user", build(F.col(typos))))
    keep = [c for c in pairs.columns if c not in (correct, typos)]
    return pairs.select(*keep, render_template(msgs, template, generation=True).alias("prompt"),
                        F.col(correct).alias("correct_text"), F.col(typos).alias("typo_text"))
