"""Keyboard-neighbour noise (C3) as one Catalyst expression per text.

For every character: lower-case it; characters that are not keys stay as they
are and consume no draw; a key is replaced when a draw in 0..99 is ``<=`` the
threshold ``int(prob*100)`` (so prob=0.1 changes ~11 %), by a character picked
uniformly from the key's neighbour string (which starts with the key itself);
the original case is restored with ``upper``.

Draws come from md5 of ``(seed, 'noise', row key)`` mixed with the character
index, so rows are independent and the result does not depend on
partitioning or retries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, rand_u

# QWERTY neighbour strings, keys a..z then space (each string
# begins with the key itself).
QWERTY_NEIGHBOURS = {
    "q": "qwasedzx",
    "w": "wqesadrfcx",
    "e": "ewrsfdqazxcvgt",
    "r": "retdgfwsxcvgt",
    "t": "tryfhgedcvbnju",
    "y": "ytugjhrfvbnji",
    "u": "uyihkjtgbnmlo",
    "i": "iuojlkyhnmlp",
    "o": "oipklujm",
    "p": "plo['ik",
    "a": "aqszwxwdce",
    "s": "swxadrfv",
    "d": "decsfaqgbv",
    "f": "fdgrvwsxyhn",
    "g": "gtbfhedcyjn",
    "h": "hyngjfrvkim",
    "j": "jhknugtblom",
    "k": "kjlinyhn",
    "l": "lokmpujn",
    "z": "zaxsvde",
    "x": "xzcsdbvfrewq",
    "c": "cxvdfzswergb",
    "v": "vcfbgxdertyn",
    "b": "bvnghcftyun",
    "n": "nbmhjvgtuik",
    "m": "mnkjloik",
    " ": " ",
}

KEYBOARDS = {"qwerty": QWERTY_NEIGHBOURS}


def _slot_array(neigh: dict[str, str]) -> list[str | None]:
    """Neighbour strings indexed by code point: slot 1 = space, 2..27 = a..z."""
    return [neigh.get(" ")] + [neigh.get(chr(cp)) for cp in range(ord("a"), ord("z") + 1)]


def _slot(lc: Column) -> Column:
    """1-based index into ``[null] + slots`` of a lower-cased character.

    Unknown characters map to the leading null entry instead of a null index:
    the array then carries ``containsNull`` and the lookup stays nullable in
    generated code (a null index on a non-null literal array is not).
    """
    cp = F.ascii(lc)
    return (
        F.when(F.length(lc) != 1, F.lit(1))
        .when(cp == 32, F.lit(2))
        .when((cp >= 97) & (cp <= 122), cp - 94)
        .otherwise(F.lit(1))
    )


# Constants of the 32-bit integer mixer used for per-character
# draws (every intermediate product stays below 2^63, so ANSI overflow checks
# never fire and DuckDB reproduces it with the same BIGINT arithmetic).
GOLDEN = 2654435761
MIX = 73244475
MASK32 = 0xFFFFFFFF


def _mix(x: Column) -> Column:
    """One xor-shift-multiply round on a value in [0, 2^32)."""
    x = (F.shiftright(x, 16).bitwiseXOR(x) * MIX).bitwiseAND(F.lit(MASK32))
    return x


def _char_draw(base: Column, i: Column) -> Column:
    """Uniform 32-bit draw for character ``i`` of a row whose base draw is ``base``."""
    x = base.bitwiseXOR(i.cast("bigint") * GOLDEN).bitwiseAND(F.lit(MASK32))
    x = _mix(_mix(x))
    return F.shiftright(x, 16).bitwiseXOR(x)


def _pick_draw(d: Column) -> Column:
    x = _mix(d)
    return F.shiftright(x, 16).bitwiseXOR(x)


def keyboard_noise(
    text: Column | str,
    row_key: Column,
    prob: float | Column = 0.1,
    seed: int = 0,
    keyboard: str = "qwerty",
    impl: str = "native",
) -> Column:
    """Noisy copy of ``text``; ``row_key`` identifies the row (and variant).

    Per row one md5 gives a base draw; per character an integer mixer of
    (base, index) gives the draw in 0..99 and, only when the character is
    replaced, the neighbour pick. The base is bound once per row through an
    outer one-element ``transform`` so the character lambda only reads it.

    An unknown keyboard returns the text unchanged (the reference prints a
    message and applies no noise).
    """
    text = col_(text)
    if keyboard not in KEYBOARDS:
        return text
    threshold = (prob * 100).cast("int") if isinstance(prob, Column) else F.lit(int(prob * 100))
    if impl == "arrow":
        return _noise_udf(keyboard, seed)(text, row_key.cast("string"), threshold)
    if impl != "native":
        raise ValueError(f"unknown noise impl {impl!r}")
    slots = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in _slot_array(KEYBOARDS[keyboard])])
    base = rand_u(seed, "noise", row_key)

    def per_row(b: Column) -> Column:
        def per_char(c: Column, i: Column) -> Column:
            lc = F.lower(c)
            neigh = F.element_at(slots, _slot(lc))
            d = _char_draw(b, i)
            new = (
                F.when(neigh.isNull(), lc)
                .when(d % 100 <= threshold, F.substring(neigh, (_pick_draw(d) % F.length(neigh)).cast("int") + 1, 1))
                .otherwise(lc)
            )
            return F.when(lc != c, F.upper(new)).otherwise(new)

        return F.array_join(F.transform(F.split(text, ""), per_char), "")

    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(
        F.element_at(F.transform(F.array(base), per_row), 1)
    )


def noise_sql_duckdb(text: str, row_key: str, prob: float = 0.1, seed: int = 0) -> str:
    """The same noise as a DuckDB expression (for oracle queries)."""
    threshold = int(prob * 100)
    slots = _slot_array(QWERTY_NEIGHBOURS)
    arr = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in slots) + "]"
    slot = (
        "(CASE WHEN length(lower(c)) <> 1 THEN NULL WHEN ascii(lower(c)) = 32 THEN 1 "
        "WHEN ascii(lower(c)) BETWEEN 97 AND 122 THEN ascii(lower(c)) - 95 END)"
    )
    neigh = f"{arr}[{slot}]"
    base = f"(('0x' || substr(md5(concat_ws(':', '{seed}', 'noise', {row_key})), 1, 8))::UBIGINT)::BIGINT"

    def mix(x: str) -> str:
        return f"((xor({x} >> 16, {x}) * {MIX}) & {MASK32})"

    def fin(x: str) -> str:
        return f"xor({x} >> 16, {x})"

    x0 = f"(xor({base}, (i - 1) * {GOLDEN}) & {MASK32})"
    d = fin(mix(mix(x0)))
    pick = f"({fin(mix(d))} % length({neigh}))"
    new = (
        f"(CASE WHEN {neigh} IS NULL THEN lower(c) WHEN {d} % 100 <= {threshold} "
        f"THEN substr({neigh}, CAST({pick} AS BIGINT) + 1, 1) ELSE lower(c) END)"
    )
    per_char = f"(CASE WHEN lower(c) <> c THEN upper({new}) ELSE {new} END)"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {per_char}), '')"


# ---------------------------------------------------------------- arrow impl

def _np_mix(x):
    import numpy as np

    return (((x >> np.uint64(16)) ^ x) * np.uint64(MIX)) & np.uint64(MASK32)


def _np_fin(x):
    import numpy as np

    return (x >> np.uint64(16)) ^ x


def noise_text(text: str, key: str, threshold: int, seed: int = 0, keyboard: str = "qwerty") -> str:
    """The same noise for one text with numpy over its code points.

    Identical draws to the Catalyst expression: md5 base per row, integer
    mixer per character index, pick only for replaced characters.
    """
    import hashlib

    import numpy as np

    neigh = KEYBOARDS[keyboard]
    base = int(hashlib.md5(f"{seed}:noise:{key}".encode()).hexdigest()[:8], 16)
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = cps.size
    if n == 0:
        return text
    # lower-cased code point per character and the pieces of non-ASCII characters
    lower = cps.copy()
    upper_ascii = (cps >= 65) & (cps <= 90)
    lower[upper_ascii] += 32
    special: dict[int, str] = {}
    for cp in np.unique(cps[cps >= 128]).tolist():
        ch = chr(cp)
        lc = ch.lower()
        if len(lc) == 1 and lc in neigh:
            lower[cps == cp] = ord(lc)
        else:
            special[cp] = (lc.upper() if lc != ch else lc)
    is_key = ((lower >= 97) & (lower <= 122)) | (lower == 32)
    if special:
        is_key &= ~np.isin(cps, np.fromiter(special.keys(), dtype=np.uint32))
    i = np.arange(n, dtype=np.uint64)
    x = (np.uint64(base) ^ (i * np.uint64(GOLDEN))) & np.uint64(MASK32)
    d = _np_fin(_np_mix(_np_mix(x)))
    hit = is_key & ((d % np.uint64(100)) <= np.uint64(threshold))
    out = np.where(is_key, lower, cps).astype(np.uint32)
    if hit.any():
        table, sizes = _neighbour_table(keyboard)
        idx = np.nonzero(hit)[0]
        lc = lower[idx]
        slot = np.where(lc == 32, 0, lc.astype(np.int64) - 96)
        picks = (_np_fin(_np_mix(d[idx])) % sizes[slot].astype(np.uint64)).astype(np.int64)
        out[idx] = table[slot, picks]
    # restore case where the original differed from its lower form
    recase = is_key & (lower != cps)
    ascii_lower = (out >= 97) & (out <= 122)
    out[recase & ascii_lower] -= 32
    if not special:
        return out.tobytes().decode("utf-32-le")
    pieces = [special.get(c) if c in special else chr(o) for c, o in zip(cps.tolist(), out.tolist())]
    return "".join(pieces)


_TABLES: dict = {}


def _neighbour_table(keyboard: str):
    """Neighbour strings as a padded code-point matrix: row 0 = space, 1..26 = a..z."""
    import numpy as np

    if keyboard not in _TABLES:
        neigh = KEYBOARDS[keyboard]
        rows = [neigh[" "]] + [neigh[chr(c)] for c in range(ord("a"), ord("z") + 1)]
        width = max(len(r) for r in rows)
        table = np.zeros((len(rows), width), dtype=np.uint32)
        for i, r in enumerate(rows):
            table[i, : len(r)] = [ord(ch) for ch in r]
        _TABLES[keyboard] = (table, np.array([len(r) for r in rows], dtype=np.uint64))
    return _TABLES[keyboard]


_UDF_CACHE: dict = {}


def _noise_udf(keyboard: str, seed: int):
    key = (keyboard, seed)
    if key not in _UDF_CACHE:
        @F.pandas_udf("string")
        def noise_batch(texts: pd.Series, keys: pd.Series, thresholds: pd.Series) -> pd.Series:
            return pd.Series([
                None if t is None else noise_text(t, k, int(th), seed, keyboard)
                for t, k, th in zip(texts.tolist(), keys.tolist(), thresholds.tolist())
            ])

        _UDF_CACHE[key] = noise_batch
    return _UDF_CACHE[key]
