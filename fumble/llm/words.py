"""Words of a batch of texts, each distinct word handled once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(texts: pa.Array) -> list[str]:
    """A column as Python strings, made by Arrow in one go; ``to_pylist`` makes a
    scalar of its own for each, which takes many times as long."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the code of every word in order, words of each text).

    Words are parted by the six ASCII white characters and lower-cased in A-Z
    only, which is what these two Arrow functions do; a null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes, starts = np.asarray(coded.indices), np.asarray(lists.offsets)
    starts = starts - starts[0]
    real = np.asarray(pc.binary_length(coded.dictionary)) > 0
    here = real[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(here)])
    return coded.dictionary, codes[here], np.diff(before[starts])
