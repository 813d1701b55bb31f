import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fumble.llm import packing as P
from tests.llm.helpers import corpus, data, frame, with_clashes

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(rows, tokens):
    enc, out = Tokenizer.from_file(FILE), []
    for r in rows:
        ids = np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, P.END], "<u4")
        out += [(r[0], k, s, len(x := ids[s : s + tokens]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), tokens))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [P.Capacity(), P.Capacity(256, 3, 256 * 256), P.Capacity(300, 300, 100_000, (1, 1, 1), "dot")])
def test_pieces_and_places(spark, capacity):
    rows = corpus()
    got = P.pack_documents(with_clashes(frame(spark, rows)), FILE, capacity)
    assert data(got, "doc_id", "piece", "start", "length", "ids_crc32") == brute_pieces(rows, capacity.tokens)
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.documents and sum(n * n for _, n in parts) <= capacity.attention


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 6))
def test_best_fit_keeps_every_constraint_and_opens_no_needless_bin(lengths, rule, documents):
    cap = P.Capacity(64, documents, 64 * 64, rule=rule)
    x = np.array(lengths)
    bins, offsets = P.best_fit(x, cap)
    used = bins.max() + 1
    for b in range(used):
        mine = np.flatnonzero(bins == b)
        assert len(mine) <= documents and x[mine].sum() <= 64 and (x[mine] ** 2).sum() <= 64 * 64
        assert sorted(offsets[mine]) == sorted(np.cumsum(x[mine[np.argsort(offsets[mine])]]) - x[mine[np.argsort(offsets[mine])]])
    # of two bins that together fit one, the later need not have been opened
    totals = np.array([(x[bins == b].sum(), (bins == b).sum()) for b in range(used)])
    small = totals[(totals[:, 0] <= 32) & (totals[:, 1] <= documents // 2)]
    assert len(small) <= 1


def test_nearly_as_few_sequences_as_the_tokens_need(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(20, 1500, 20_000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")
    used = P.pack(df).select("sequence_id").distinct().count()
    assert used <= 1.005 * sizes.sum() / 2048 + 2


def test_ids_of_sequences(spark):
    rows = [(1, "a b c", "x", "y", 0), (2, None, "x", "y", 0), (3, "d " * 30, "x", "y", 0)]
    got = P.sequences(P.pack_documents(frame(spark, rows), FILE, P.Capacity(16, 16, 256), with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert len(ids) == 4 + 1 + 31 and (ids == P.END).sum() == 3


def test_edges(spark):
    assert P.pack_documents(frame(spark, []), FILE).count() == 0
    with pytest.raises(ValueError):
        P.Capacity(64, 0, 4096)


def test_attention_and_document_limits_bind():
    """Limits that tokens alone would not meet; a piece above the attention limit stands alone."""
    lengths = np.array([100, 60, 40, 40, 30, 20, 10, 10, 5, 5, 5, 5])
    for rule in ("norm", "dot"):
        cap = P.Capacity(tokens=100, documents=3, attention=3600, rule=rule)
        b, _ = P.best_fit(lengths, cap)
        for i in set(b.tolist()):
            own = lengths[b == i]
            assert own.sum() <= 100 and len(own) <= 3 and (len(own) == 1 or (own**2).sum() <= 3600)
        assert (b == b[0]).sum() == 1 and (b == b[1]).sum() == 1  # 100 and 60 use the attention up
        assert max(np.bincount(b)) == 3
        wide, _ = P.best_fit(lengths, P.Capacity(tokens=100, rule=rule))
        assert (wide == wide[1]).sum() > 1 and max(np.bincount(wide)) > 3


def test_rest_of_a_batch_waits_for_the_next_shard(spark):
    """A task of several batches packs full shards and one rest, whatever the batches' size."""
    rows = spark.createDataFrame([(i, 1 + i % 7) for i in range(1000)], "doc_id long, length long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        got = P.pack(rows.coalesce(1), P.Capacity(tokens=10**6, documents=10**6, attention=10**12), shard=64).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(Counter(r.sequence_id for r in got).values()) == [1000 % 64] + [64] * (1000 // 64)
