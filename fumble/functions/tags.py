"""Tagged-reasoning text functions (F14–F18) as Column builders.

A closed block ``<tag>…</tag>`` exists iff a closing marker starts after the
end of the first opening marker — found with ``instr``/``locate`` instead of a
lazy regex search. Extraction uses a ``(?s)`` lazy group, which Java and RE2
read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_strip

# Tag markers, the fallback answer marker and the stems counted
# in a reasoning block.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
ANSWER_MARKER = "Odpowiedź:"
ERROR_STEMS = ("błąd", "literówk", "poprawi", "zmieni", "powinno", "zamiast", "nieprawidłow", "pomył", "źle", "poprawnie")
LEGACY_STEMS = ("błąd", "literówk", "poprawi", "zmieni", "powinno", "zamiast")


def has_block(c: Column | str, open_: str, close: str) -> Column:
    """``re.search(open.*?close, c, DOTALL)`` is not None."""
    c = col_(c)
    first = F.instr(c, open_)
    after = F.call_function("locate", F.lit(close), c, first + len(open_))
    return F.coalesce((first > 0) & (after > 0), F.lit(False))


def has_think(c: Column | str) -> Column:
    return has_block(c, THINK_OPEN, THINK_CLOSE)


def has_answer(c: Column | str) -> Column:
    return has_block(c, ANSWER_OPEN, ANSWER_CLOSE)


def proper_format(c: Column | str) -> Column:
    """Both blocks closed and the first think marker precedes the first answer marker."""
    c = col_(c)
    return has_think(c) & has_answer(c) & (F.instr(c, THINK_OPEN) < F.instr(c, ANSWER_OPEN))


def _block_regex(open_: str, close: str) -> str:
    return f"(?s){open_}(.*?){close}"


def outside_ratio(c: Column | str) -> Column:
    """share of the stripped text left after removing closed blocks, then
    stray markers (in the order think, /think, answer, /answer); 0 if empty."""
    c = col_(c)
    rest = F.regexp_replace(c, _block_regex(THINK_OPEN, THINK_CLOSE), "")
    rest = F.regexp_replace(rest, _block_regex(ANSWER_OPEN, ANSWER_CLOSE), "")
    for marker in (THINK_OPEN, THINK_CLOSE, ANSWER_OPEN, ANSWER_CLOSE):
        rest = F.replace(rest, F.lit(marker), F.lit(""))
    total = F.length(py_strip(c))
    return F.when(total > 0, F.length(py_strip(rest)) / total).otherwise(F.lit(0.0))


def extract_answer(c: Column | str) -> Column:
    """F16: first answer block (stripped); else text after the last answer
    marker; else the whole text, stripped."""
    c = col_(c)
    block = py_strip(F.regexp_extract(c, _block_regex(ANSWER_OPEN, ANSWER_CLOSE), 1))
    after_marker = py_strip(F.substring_index(c, ANSWER_MARKER, -1))
    return (
        F.when(has_answer(c), block)
        .when(F.instr(c, ANSWER_MARKER) > 0, after_marker)
        .otherwise(py_strip(c))
    )


def extract_reasoning(c: Column | str) -> Column:
    """first think block, stripped ('' when there is none)."""
    return py_strip(F.regexp_extract(col_(c), _block_regex(THINK_OPEN, THINK_CLOSE), 1))


def stem_mentions(text_lower: Column, stems: tuple[str, ...] = ERROR_STEMS) -> Column:
    """how many of ``stems`` occur in the (lower-cased) text; each counts once."""
    arr = F.array(*[F.lit(s) for s in stems])
    return F.size(F.filter(arr, lambda s: F.instr(text_lower, s) > 0)).cast("bigint")


def format_check(c: Column | str) -> list[Column]:
    """``has_think, has_answer, proper_format, outside_ratio``."""
    c = col_(c)
    return [
        has_think(c).alias("has_think"),
        has_answer(c).alias("has_answer"),
        proper_format(c).alias("proper_format"),
        outside_ratio(c).alias("outside_ratio"),
    ]
