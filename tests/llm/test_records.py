import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fumble.llm import records as R
from fumble.llm.shared import shared_path
from tests.llm.helpers import corpus, data, frame, with_clashes

FILE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(rows):
    enc = Tokenizer.from_file(FILE)
    return [(r[0], np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, R.END], "<u4")) for r in rows]


def test_round_trip_in_ascending_order(spark):
    rows = corpus()
    got = [tuple(r) for r in R.token_records(with_clashes(frame(spark, rows)), FILE).orderBy("start").collect()]
    want = sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in ids_of(rows))
    assert [(g[0] is not None, g[0] or 0) for g in got] == [w[:2] for w in want]
    assert sorted((g[0] is not None, g[0] or 0, g[2], g[3]) for g in got) == want
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]


def test_index_gives_shuffled_reads_and_damage_is_found(spark):
    rows, out = corpus(), shared_path(spark, "records-test")
    index = R.write_records(frame(spark, rows), FILE, out).collect()
    want = sorted((repr(d), x.tobytes()) for d, x in ids_of(rows))
    got = [R.read_one(out, r.path, r.offset) for r in index]
    assert sorted((repr(d), x.tobytes()) for d, x in got) == want
    assert all(len(x) == r.n_tokens and d == r.doc_id for (d, x), r in zip(got, index, strict=True))
    with pytest.raises(Exception, match="damaged|unpack"):
        R.read_one(out, index[0].path, index[0].offset + 1)


def test_frames():
    import io

    for doc, ids in ((5, [1, 2, 65535]), (None, [70000]), (-1, [])):
        x = np.array(ids, np.int64)
        data_ = R.frame(doc, x)
        back = R.parse(R.read_record(io.BytesIO(data_)))
        assert back[0] == doc and back[1].tolist() == ids
        for i in range(len(data_)):
            bad = bytearray(data_)
            bad[i] ^= 1
            with pytest.raises((ValueError, OverflowError, MemoryError)):
                R.read_record(io.BytesIO(bytes(bad)))


def test_empty_table(spark):
    assert data(R.token_records(frame(spark, []), FILE), "doc_id") == []
