"""Text primitives shared by every job, as Spark ``Column`` builders.

Python's ``str.strip``/``str.split``/``re`` ``\\s`` are Unicode-aware while
Spark's ``trim`` removes spaces only and Java's ``\\s`` is ASCII-only, so every
whitespace-sensitive operator goes through the one character class below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace (str.isspace).
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Same class as a Java regex and as an RE2 (DuckDB) regex.
WS_JAVA = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``s.strip()``: remove Unicode whitespace at both ends (no regex)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def _spaces(c: Column | str) -> Column:
    """Every whitespace character mapped to a plain space (``translate``, no regex)."""
    return F.translate(col_(c), WS_CHARS, " " * len(WS_CHARS))


def words_joined(c: Column | str) -> Column:
    """``' '.join(s.split())``: whitespace to spaces, trim, collapse runs.

    The collapsing regex only runs on texts that contain a double space."""
    t = F.btrim(_spaces(c), F.lit(" "))
    return F.when(F.instr(t, "  ") > 0, F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def word_count(c: Column | str) -> Column:
    """``len(s.split())`` as bigint."""
    w = words_joined(c)
    return F.when(F.length(w) == 0, F.lit(0)).otherwise(
        F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) + 1
    ).cast("bigint")


def norm_key(c: Column | str) -> Column:
    """Join key for prompts: all whitespace removed, lower-cased; null -> ''."""
    return F.lower(F.translate(F.coalesce(col_(c), F.lit("")), WS_CHARS, ""))


def key_string(seed: int, salt: str, *keys: Column | str) -> Column:
    """``seed:salt:k1:k2...`` — the input of every deterministic draw."""
    parts = [F.lit(str(seed)), F.lit(salt)] + [col_(k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def hex_u32(h: Column, offset: int = 1) -> Column:
    """8 hex digits of an md5 string starting at ``offset`` as a bigint in [0, 2^32)."""
    return F.conv(F.substring(h, offset, 8), 16, 10).cast("bigint")


def rand_u(seed: int, salt: str, *keys: Column | str) -> Column:
    """Deterministic uniform draw in [0, 2^32) from md5 of the keys.

    Reproducible in any engine with md5 (DuckDB:
    ``('0x'||substr(md5(concat_ws(':',...)),1,8))::UBIGINT``), independent per
    row, and free of per-task state, so it survives retries and re-partitioning.
    """
    return hex_u32(F.md5(key_string(seed, salt, *keys)))


def rand_id(seed: int, salt: str, *keys: Column | str) -> Column:
    """A 60-bit identifier (first 15 hex digits of md5) as bigint."""
    return F.conv(F.substring(F.md5(key_string(seed, salt, *keys)), 1, 15), 16, 10).cast("bigint")


def truncate(c: Column | str, n: int) -> Column:
    """``s[:n]`` for display columns."""
    return F.substring(col_(c), 1, n)
