"""Exact Jaccard self-join of word shingles as a metric-space join.

The Jaccard distance 1 - J is a metric; documents link within ``radius``.

1. Coarse regions. Shingles are ordered by their hash. Linked sets x and y share
   at least l of their first n - ceil(0.8 n) + l shingles, with l a tenth of the
   smaller set. One pass over the texts counts, for every document, how many of
   these first shingles occur in another text; who has too few is linked with
   nothing, and so are most documents that only share a passage. Of those left
   all shingles are counted, and each document takes its first
   n - ceil(0.8 n) + 1 with the rarest first: a passage that many documents share
   is then in no prefix but of documents that hold little else. They are joined
   with the least document that has the shingle; the connected components are
   regions that no link leaves. Each task sums up what it holds before the
   shuffle, so a shingle held by very many documents leaves a task as few rows.
2. Voronoi split. A region above ``leaf`` shingles takes pivots; every document
   goes to its nearest pivot's region, and also to that of each pivot q with
   d(x, q) - d(x, nearest) <= 2 radius: by the triangle inequality a partner
   lies in one of them. Documents without a shingle in common with any pivot
   form an outer region, with those whose nearest pivot is at 1 - radius or
   more. Regions that shrink are split again; small ones are joined whole.
3. Rounds. A dense region does not shrink, since its documents are all alike;
   there documents outside the largest component found so far become pivots,
   ``BLOCK`` shingles a round - a broadcast of fixed size - against all documents
   of such regions, until none is left: every pair in different components has
   then been compared by one side.
4. Inside a small region the same rule runs on an inverted index.

Documents with equal sets count as one; links are never dropped, but pairs
inside a known component need no test, since only components are returned.
Sets hold 64-bit hashes of their shingles.

Defined results: a null or empty text has an empty set and links with nothing;
fewer than ``k`` words are one shingle; a null doc_id links like any other and
names a component only if all its ids are null; rows that repeat a doc_id give
a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fumble.llm.components import components
from fumble.llm.shared import frame_of, id_key, keep, release, scratch, session_with, taken, text_digest, through, trimmed, with_package
from fumble.llm.tokens import encoder, ragged, slices
from fumble.llm.url_filter import bloom_block, bloom_mask, bloom_table
from fumble.llm.words import word_codes

K = 5
PERCENT = 80  # similarity in per cent, as a whole number: the test is exact
LEAF = 1 << 20  # shingles of a region that one task joins
PIVOTS = 64
BLOCK, BLOCK_SETS = 1 << 20, 1 << 13  # shingles and sets of one round's pivots, 8 MB
DEPTH = 4
SHARE = 10  # a tenth of a set's shingles must be met again
ROWS = 1000  # rows of an Arrow batch at a time: sets are large rows
HELD = 1 << 19  # shingles that a task joins before it sends them, or reads before it counts them
PART = 1 << 22  # bytes of text at a time
CAP = 256  # sets up to which a shingle's count is told, so that the rarest come first
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEPS = _MIX * np.arange(1, 6, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``k``
    words; a text of fewer words has one, a text of none has none."""
    for first, rows in slices(texts, PART):
        yield from _part_sets(texts.slice(first, rows), k)


def _part_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    words, codes, counts = word_codes(texts)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    h = of_word[codes]
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        x = h[i : i + len(rolled)] + _STEPS[i % len(_STEPS)]
        rolled = (rolled ^ (x ^ (x >> np.uint64(29)))) * _MIX[0]
        rolled ^= rolled >> np.uint64(32)
    start = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(rolled[start : start + n - k + 1])
        else:
            whole = h[start : start + n].tobytes()
            yield np.array([xxhash.xxh3_64_intdigest(whole, seed=n)] if n else [], np.uint64)
        start += n


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first in range(0, b.num_rows, ROWS):
            yield b.slice(first, ROWS)


def node_of(d: bytes) -> int:
    """The half of a digest that stands for a set among the coarse edges."""
    return int.from_bytes(d[:8], "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_digest(text_col).alias("own"))


def prefix_length(n: int, percent: int = PERCENT, shared: int = 1) -> int:
    """First shingles of which linked sets share ``shared``."""
    return n - -(-n * percent // 100) + shared


def must_share(n: int) -> int:
    return max(1, n // SHARE)


def least_shared(n: Column, percent: int) -> Column:
    """What a set of ``n`` shares at least with any partner, which may be as small as ceil(0.8 n)."""
    smallest = F.ceil(n * percent / 100)
    return F.greatest(F.lit(1), F.floor(smallest / SHARE))


def _grouped(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, node) pairs in order, the first place of each token's run, and the size of each pair's run."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return token, node, first, np.diff(np.append(first, len(token)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _tally(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(nodes, return_counts=True)


# what a task sends: a document (doc_id, n, digest, node, digest of its text), a shingle (token, node, met), or a count (node, n)
SENT = "kind string, key long, doc_id long, n long, digest binary, node long, met boolean, own binary"
_SENT = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())


def _sent(kind: str, rows: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in SENT.split(", ")]
    columns["kind"] = [kind] * rows
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, _SENT, strict=True)], names)


def documents_and_counts(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """One pass over all texts: rows "doc" (doc_id, n, digest, node, own) and rows
    "count" (node, n): how many of a set's first shingles another text has.

    The shuffle sorts by shingle, so a task holds the rows of a few shingles at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # Spark reuses workers: what a tokenizing stage remembered in this one makes room
        tokens, nodes, held = [], [], 0
        for b in _cut(batches):
            rows = []
            for doc, own, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(1), k), strict=True):
                d = digest(s)
                node = node_of(d)
                rows.append((doc, len(s), d, node, own))
                if len(s):
                    first = s[: prefix_length(len(s), percent, must_share(len(s)))].view(np.int64)
                    tokens.append(first)
                    nodes.append(np.full(len(first), node))
                    held += len(first)
                if held >= HELD:
                    yield from local(tokens, nodes)
                    tokens, nodes, held = [], [], 0
            if rows:
                docs, n, digests, names, owns = zip(*rows, strict=True)
                yield _sent("doc", len(rows), key=range(len(rows)), doc_id=docs, n=n, digest=digests, node=names, own=owns)
        yield from local(tokens, nodes)

    def local(tokens: list, nodes: list) -> Iterator[pa.RecordBatch]:
        t, node, first, size = _grouped(_joined(tokens), _joined(nodes))
        met = np.repeat(size > 1, size)
        yield _sent("shingle", len(first), key=t[first], node=node[first], met=size > 1)
        names, n = _tally(node[met])
        yield _sent("count", len(names), key=names, node=names, n=n)

    def met_again(key: np.ndarray, node: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of whole shingles; a task sends a shingle once for each HELD
        shingles that it reads, so a very common one stays a few rows."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        # another text: another sender's node, or one that its own sender met already
        other = np.repeat(np.maximum.reduceat(node, first) != np.minimum.reduceat(node, first), size) if len(key) else np.zeros(0, bool)
        return _tally(node[other & ~met])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tallies: list[tuple] = []
        rows = 0

        def tally(least: int) -> Iterator[pa.RecordBatch]:
            """One row a node for all counts so far, if they are ``least`` at least."""
            if tallies and sum(len(x) for x, _ in tallies) >= least:
                names, at = np.unique(np.concatenate([x for x, _ in tallies]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in tallies]), len(names)).astype(np.int64)
                tallies[:] = [(names, n)]
                if len(names) >= least // 2:
                    yield _sent("count", len(names), key=names, node=names, n=n)
                    tallies.clear()

        for b in batches:
            kind = np.asarray(pc.equal(b.column(0), "shingle").cast(pa.uint8())).astype(bool)
            if not kind.all():
                yield b.filter(pa.array(~kind))
            if not kind.any():
                continue
            some = b.filter(pa.array(kind))
            held.append((np.asarray(some.column(1)), np.asarray(some.column(5)), np.asarray(some.column(6).cast(pa.uint8())).astype(bool)))
            rows += some.num_rows
            if rows >= HELD:  # all but the last shingle, whose rows may go on
                key, node, met = (np.concatenate(c) for c in zip(*held, strict=True))
                last = int(np.searchsorted(key, key[-1]))
                tallies.append(met_again(key[:last], node[:last], met[:last]))
                held, rows = [(key[last:], node[last:], met[last:])], len(key) - last
                yield from tally(HELD)
        if held:
            tallies.append(met_again(*(np.concatenate(c) for c in zip(*held, strict=True))))
        yield from tally(0)

    return texts.mapInArrow(trimmed(read), SENT).repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(meet), SENT)


def _runs(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by column ``of``, about ``HELD`` rows at a time, with each of its values in one part."""
    held, rows = [], 0
    for b in batches:
        held.append(tuple(np.asarray(c.cast(pa.uint8()) if pa.types.is_boolean(c.type) else c) for c in b.columns))
        rows += b.num_rows
        if rows >= HELD:  # all but the last value, whose rows may go on
            columns = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(columns[of], columns[of][-1]))
            if last:
                yield tuple(c[:last] for c in columns)
            held, rows = [tuple(c[last:] for c in columns)], len(columns[of]) - last
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _columns(schema: str, *columns) -> pa.RecordBatch:
    """A batch of the named columns of whole numbers or truths."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == "boolean" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], names)


def rare_prefixes(members: DataFrame, percent: int, cap: int = CAP) -> DataFrame:
    """(number, token) of the prefixes of sets, the rarest shingles first, as a
    written table; a null token stands for the first shingles by hash.

    The order is any that all sets share: shingles of one set, then those of at
    most ``cap`` sets by the count of these, then all others by hash. A set whose
    prefix is its own alone has no partner and no row. Shingles of more sets are
    not sent back: a set that needs them is named, and its first shingles by hash,
    as many as its prefix, hold those that it needs. A task that holds such a
    shingle in more than ``cap`` of ``HELD`` shingles' sets sends one row of it."""
    sent, seen = "token long, number long, common boolean", "number long, sets long, token long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, node, first, size = _grouped(_joined(tokens), np.repeat(np.array(numbers, np.int64), [len(x) for x in tokens]))
            common = np.repeat(size > cap, size)
            here = ~common
            here[first] = True
            yield _columns(sent, token[here], node[here], common[here])

        for b in _cut(batches):
            for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                numbers.append(number)
                tokens.append(np.frombuffer(raw, np.int64))
                held += len(tokens[-1])
                if held >= HELD:
                    yield from flush()
                    numbers, tokens, held = [], [], 0
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of 2 to ``cap`` sets for each of these, and with 1 in place of the sets how many a set has alone."""
        for token, number, common in _runs(batches, 0):
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            size[(size > cap) | (np.maximum.reduceat(common, first) > 0)] = 0
            sets = np.repeat(size, np.diff(np.append(first, len(token))))
            some = sets > 1
            yield _columns(seen, number[some], sets[some], token[some])
            names, alone = _tally(number[sets == 1])
            yield _columns(seen, names, np.ones(len(names), np.int64), alone)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, sets, token in _runs(batches, 0):
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            rows = np.diff(np.append(first, len(number)))
            n = token[first]  # a set's first row has 0 in place of the sets, and its size
            alone = np.add.reduceat(np.where(sets == 1, token, 0), first)
            shared = np.add.reduceat((sets > 1).astype(np.int64), first)
            wanted = prefix_length(n, percent) - alone
            place = np.arange(len(number)) - np.repeat(first + rows - shared, rows)  # among its shingles of several sets
            taken_ = (place >= 0) & (place < np.repeat(wanted, rows))
            short = number[first][wanted > shared]
            yield _columns("number long, token long", np.concatenate([number[taken_], short]), pa.concat_arrays([pa.array(token[taken_], pa.int64()), pa.nulls(len(short), pa.int64())]))

    counted = members.select("number", "shingles").mapInArrow(trimmed(read), sent).repartition("token").sortWithinPartitions("token").mapInArrow(trimmed(count), seen)
    rows = counted.unionByName(members.select("number", F.lit(0).cast("long").alias("sets"), F.col("n").alias("token")))
    return keep(rows.repartition("number").sortWithinPartitions("number", "sets", "token").mapInArrow(trimmed(choose), "number long, token long"), "jaccard-rare")


def coarse_edges(members: DataFrame, percent: int, cap: int = CAP) -> DataFrame:
    """(a, b): numbers of sets joined through shingles of their prefixes; ``members``: number, n, shingles."""

    def stars(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens, the least node of each, and the pairs of other nodes with these."""
        token, node, first, size = _grouped(token, node)
        least = np.repeat(node[first], size)
        pairs = np.unique(np.stack([node, least])[:, node != least], axis=1) if len(token) else np.zeros((2, 0), np.int64)
        return token[first], node[first], pairs

    def batch(token: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        column = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([column(token), column(a), column(b)], ["token", "a", "b"])

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            firsts = [s[: prefix_length(len(s), percent)] for s in (np.frombuffer(raw, np.int64) for raw in b.column(1).to_pylist())]
            yield _columns("number long, token long", np.repeat(np.asarray(b.column(0)), [len(x) for x in firsts]), _joined(firsts))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, least, pairs = stars(_joined(tokens), _joined(numbers))
            yield batch(token, least, None)
            yield batch(None, pairs[0], pairs[1])

        for b in batches:
            numbers.append(np.asarray(b.column(0)))
            tokens.append(np.asarray(b.column(1)))
            held += b.num_rows
            if held >= HELD:
                yield from flush()
                numbers, tokens, held = [], [], 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node in _runs(batches, 0):
            yield batch(None, *stars(token, node)[2])

    kinds = "token long, a long, b long"
    rare = rare_prefixes(members, percent, cap)
    common = members.join(rare.filter("token is null").select("number"), "number", "left_semi").select("number", "shingles")
    prefixes = rare.filter("token is not null").unionByName(common.mapInArrow(trimmed(by_hash), "number long, token long"))
    first = keep(prefixes.mapInArrow(trimmed(local), kinds), "jaccard-prefixes")
    release(rare)
    met = first.filter("token is not null").select("token", "a").repartition("token").sortWithinPartitions("token").mapInArrow(trimmed(meet), kinds)
    edges = first.filter("token is null").select("a", "b").unionByName(met.select("a", "b"))
    edges.kept_at = first.kept_at
    return edges


class Region:
    """Sets of one region with an inverted index, and the components found so far."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets], np.int64), percent
        flat = np.concatenate(sets)
        self.ids = np.unique(flat, return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.ids, kind="stable")
        self.owners = owner[order]
        self.first = np.searchsorted(self.ids[order], np.arange(self.ids.max() + 2))
        self.root = np.arange(len(sets))

    def linked(self, i: int) -> np.ndarray:
        """All documents within the radius of document ``i``."""
        mine = self.ids[self.starts[i] : self.starts[i + 1]]
        size = self.first[mine + 1] - self.first[mine]
        at = np.repeat(self.first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= self.percent * (self.sizes[i] + self.sizes - both))

    def join(self) -> np.ndarray:
        done = np.zeros(len(self.sizes), bool)
        while True:
            values, counts = np.unique(self.root, return_counts=True)
            if len(values) == 1:
                return self.root
            open_ = np.flatnonzero(~done & (self.root != values[counts.argmax()]))
            if not len(open_):
                return self.root
            for i in open_[:PIVOTS]:
                roots = np.unique(self.root[self.linked(i)])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
                done[i] = True


def leaf_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) numbers: a star over each component of each region; ``members``: region, number, n, shingles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, numbers, sets = None, [], []

        def done() -> pd.DataFrame:
            if len(sets) < 2:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            root, names = Region(sets, percent).join(), np.array(numbers)
            other = np.flatnonzero(root != np.arange(len(root)))
            return pd.DataFrame({"a": names[other], "b": names[root[other]]})

        for f in frames:
            for region, d, s in zip(f["region"], f["number"], f["shingles"], strict=True):
                if region != key:
                    yield done()
                    key, numbers, sets = region, [], []
                numbers.append(d)
                sets.append(np.frombuffer(s, np.uint64))
        yield done()

    # dealt by a value of its own: rows that a join has dealt by region would not be dealt again, and AQE may still read that join's rows as they were before
    dealt = members.select("region", "number", "shingles", F.xxhash64("region", F.lit("leaf")).alias("dealt")).repartition("dealt")
    return dealt.drop("dealt").sortWithinPartitions("region", "number").mapInPandas(trimmed(run), "a long, b long")


def _beside_pivots(members: DataFrame, pivots: DataFrame, chunk: int, run, schema: str) -> DataFrame:
    """Each chunk of a region's documents in one task, after the region's pivots
    (at most ``PIVOTS`` sets); the chunks part a large region evenly."""
    total = members.groupBy("region").agg(F.sum("n").alias("total"))
    chunks = total.select("region", F.ceil(F.col("total") / F.lit(chunk)).cast("long").alias("chunks"))
    docs = members.join(chunks, "region").withColumn("chunk", F.pmod(F.xxhash64("number"), F.col("chunks"))).drop("chunks").withColumn("pivot", F.lit(False))
    heads = pivots.join(chunks, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks").withColumn("pivot", F.lit(True))
    both = docs.select("region", "chunk", "pivot", "number", "n", "shingles").unionByName(heads.select("region", "chunk", "pivot", "number", "n", "shingles"))
    return both.repartition("region", "chunk").sortWithinPartitions("region", "chunk", F.col("pivot").desc(), "number").mapInPandas(trimmed(run), schema)


def _with_distances(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(region, numbers, pivot numbers, sizes, pivot sizes, intersections, raw sets) of runs of documents."""
    key, heads = None, []
    for f in (f.iloc[i : i + ROWS] for f in frames for i in range(0, len(f), ROWS)):
        f = f.reset_index(drop=True)
        edges = np.flatnonzero(((f["region"] != f["region"].shift()) | (f["chunk"] != f["chunk"].shift())).to_numpy())
        for first, last in zip(edges, [*edges[1:], len(f)], strict=True):
            part = f.iloc[first:last]
            if (here := (part["region"].iloc[0], part["chunk"].iloc[0])) != key:
                key, heads = here, []
            is_pivot = part["pivot"].to_numpy()
            heads += [(d, np.frombuffer(s, np.uint64)) for d, s in zip(part["number"][is_pivot], part["shingles"][is_pivot], strict=True)]
            docs = part[~is_pivot]
            if not len(docs) or not heads:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in docs["shingles"]]
            sizes = np.array([len(s) for s in sets])
            flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            both = np.empty((len(sets), len(heads)), np.int64)
            for j, (_, p) in enumerate(heads):
                at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
                both[:, j] = np.add.reduceat((p[at] == flat).astype(np.int64), starts)
            yield key[0], docs["number"].tolist(), [d for d, _ in heads], sizes, np.array([len(p) for _, p in heads]), both, docs["shingles"].tolist()


def split(members: DataFrame, pivots: DataFrame, percent: int, chunk: int, sizes_only: bool = False) -> DataFrame:
    """Voronoi regions of large regions: rows (region, number, n, shingles) of the
    new ones, and links to pivots (a, b) with a null region. ``sizes_only``
    leaves out all but the sizes n."""
    radius = 1 - percent / 100 + 1e-9

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for region, numbers, heads, sizes, head_sizes, both, raw in _with_distances(frames):
            union = sizes[:, None] + head_sizes[None, :] - both
            d = 1 - both / union
            nearest = d.min(1)
            near = (d - nearest[:, None] <= 2 * radius) & (nearest < 1)[:, None]
            rows, outer = [], nearest >= 1 - radius
            if sizes_only:
                yield frame_of([(0, None, int((near.sum(1) + outer) @ sizes), None, None)], "region:Int64 number:Int64 n:Int64 shingles:object other:Int64")
                continue
            for i, j in zip(*np.nonzero(near), strict=True):
                rows.append((xxhash.xxh3_64_intdigest(int(heads[j]).to_bytes(8, "little"), seed=int(region) & 0xFFFFFFFF) >> 1, numbers[i], int(sizes[i]), raw[i], None))
            for i in np.flatnonzero(outer):
                rows.append((xxhash.xxh3_64_intdigest(b"outer", seed=int(region) & 0xFFFFFFFF) >> 1, numbers[i], int(sizes[i]), raw[i], None))
            for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True):
                if numbers[i] != heads[j]:
                    rows.append((None, numbers[i], None, None, heads[j]))
            yield frame_of(rows, "region:Int64 number:Int64 n:Int64 shingles:object other:Int64")

    return _beside_pivots(members, pivots, chunk, run, "region long, number long, n long, shingles binary, other long")


def block_links(members: DataFrame, block: list[tuple[int, np.ndarray]], percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between the members
    and the sets of a block, as a written table; the broadcast block is given up
    after that. A member is linked with one set of the block, and a task joins
    the sets that a member links, so no task sends all pairs of a dense region."""
    sent = members.sparkSession.sparkContext.broadcast(block)  # at most BLOCK shingles, or one set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets = zip(*sent.value, strict=True)
        names = np.array(names, np.int64)
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        tokens, first = np.unique(flat[order], return_index=True)
        first = np.append(first, len(flat))
        root = np.arange(len(sets))

        def links(a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in _cut(batches):
            left, right = [], []
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                at = at[tokens[at] == s]
                both = np.bincount(owner[ragged(first[at], first[at + 1] - first[at])], minlength=len(sets))
                near = np.flatnonzero(100 * both >= percent * (len(s) + sizes - both))
                if not len(near):
                    continue
                roots = np.unique(root[near])
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
                if names[near[0]] != d:
                    left.append(d)
                    right.append(names[near[0]])
            yield links(left, right)
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield links(names[joined], names[root[joined]])

    found = keep(members.select("number", "shingles").mapInArrow(trimmed(run), "a long, b long"), "jaccard-links")
    sent.destroy()
    return found


def first_of_region(rows: DataFrame, pivots: int) -> DataFrame:
    """At most ``pivots`` sets of each region, by number; planned as a limit per task first."""
    w = Window.partitionBy("region").orderBy("number")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= pivots).drop("_r")


def next_block(open_: DataFrame, members: DataFrame, block: int) -> list[tuple[int, np.ndarray]]:
    """The next pivots: open sets in order of number, as many as hold ``block`` shingles, one at least."""
    order = Window.orderBy("number")  # over at most BLOCK_SETS rows
    some = open_.select("number", "n").distinct().orderBy("number").limit(BLOCK_SETS).withColumn("upto", F.sum("n").over(order)).withColumn("place", F.row_number().over(order))
    chosen = some.filter((F.col("upto") <= block) | (F.col("place") == 1)).select("number")
    rows = members.join(chosen, "number", "left_semi").select("number", "shingles").dropDuplicates(["number"]).collect()
    return [(r["number"], np.frombuffer(bytes(r["shingles"]), np.uint64)) for r in rows]


def rounds(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame | None:
    """Links (a, b) of regions too dense to split; see 3. in the module's text."""
    spark = members.sparkSession
    state = keep(members.select("region", "number", "n", F.col("number").alias("comp"), F.lit(False).alias("done")), "jaccard-state")
    links = None
    while True:
        sizes = state.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"))
        largest = sizes.groupBy("region").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"))
        open_ = state.join(largest, "region").filter((F.col("comp") != F.col("largest")) & ~F.col("done"))
        pivots = next_block(open_, members, block)
        if not pivots:
            release(state)
            return links
        found = block_links(members, pivots, percent)
        links = found if links is None else links.unionByName(found)
        # components of this round's links, between the components known before
        name = state.select(F.col("number").alias("d"), "region", "comp")
        ends = found.join(name.select(F.col("d").alias("a"), "region", F.col("comp").alias("ca")), "a").join(name.select(F.col("d").alias("b"), "region", F.col("comp").alias("cb")), ["b", "region"])
        merged = components(ends.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        chosen = spark.createDataFrame([(d, True) for d, _ in pivots], "number long, now boolean")  # at most BLOCK_SETS rows
        before = state
        state = state.join(merged.withColumnRenamed("node", "comp"), "comp", "left").join(F.broadcast(chosen), "number", "left")
        state = keep(state.select("region", "number", "n", F.coalesce("root", "comp").alias("comp"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "jaccard-state")
        release(before)


def region_links(members: DataFrame, percent: int, leaf: int = LEAF, pivots: int = PIVOTS, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) whose components are those of all links inside the regions."""
    links = held = None
    add = lambda found: found if links is None else links.unionByName(found)
    for level in range(depth + 1):
        total = members.groupBy("region").agg(F.sum("n").alias("total"))
        sized = members.join(total, "region")
        links = add(keep(leaf_links(sized.filter(F.col("total") <= leaf), percent), "jaccard-links"))
        large = sized.filter(F.col("total") > leaf)
        if large.isEmpty():
            return links
        large = keep(large, "jaccard-large")
        if held is not None:  # the cells that these members came from
            release(held)
        held = large
        if level == depth:
            break
        heads = first_of_region(large.drop("total"), pivots)
        # a split helps if its regions hold little more than the old ones; else the region is dense
        before, after = large.agg(F.sum("n")).first()[0], split(large, heads, percent, leaf // 8, sizes_only=True).agg(F.sum("n")).first()[0]
        if after > 2 * before:
            break
        held = keep(split(large, heads, percent, leaf // 8), "jaccard-cells")
        release(large)
        links = links.unionByName(keep(held.filter("region is null").select(F.col("number").alias("a"), F.col("other").alias("b")), "jaccard-links"))
        members = held.filter("region is not null").select("region", "number", "n", "shingles")
    dense = rounds(large.drop("total"), percent, block)
    release(held)
    return links if dense is None else links.unionByName(dense)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, leaf: int = LEAF, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    with_package(docs.sparkSession)
    with scratch(docs.sparkSession):
        sets, of_set = _components(_texts(docs, id_col, text_col), k, percent, leaf, pivots, block)
        own = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
        return keep(sets.join(of_set, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id")), "jaccard-components", outlives=True)


def _components(texts: DataFrame, k: int, percent: int, leaf: int, pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (doc_id, n_shingles, digest, own), and for each
    set digest the least document of its component: least (no_id, doc_id, own)."""
    first = keep(documents_and_counts(texts, k, percent), "jaccard-sets")
    sets = first.filter("kind = 'doc'").select("doc_id", F.col("n").alias("n_shingles"), "digest", "node", "own")
    counts = first.filter("kind = 'count'").groupBy("node").agg(F.sum("n").alias("met"))
    named = sets.filter("n_shingles > 0").groupBy("digest", "node", "n_shingles").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own")).alias("first"))
    named = named.withColumn("first_id", F.col("first.doc_id"))
    wanted = named.join(counts, "node").filter(F.col("met") >= least_shared(F.col("n_shingles"), percent))
    # a number for each open set: whole numbers are narrow in edges and aggregate by hash
    open_ = keep(wanted.select("digest", "first_id", F.monotonically_increasing_id().alias("number")), "jaccard-open")
    members = keep(open_members(texts, open_, k), "jaccard-members")
    # sets are large rows: batches of few rows bound what stands between Spark and a Python worker
    members = through(members, session_with(texts.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS)))
    edges = coarse_edges(members, percent)
    region = components(edges).select(F.col("node").alias("number"), F.xxhash64("root").alias("region"))
    release(edges)
    links = region_links(members.join(region, "number"), percent, leaf, pivots, block)
    release(members)
    found = through(keep(components(links), "jaccard-found"), texts.sparkSession)
    linked = open_.join(found.withColumnRenamed("node", "number"), "number").select("digest", "root")
    linked = linked.join(named.select("digest", "first"), "digest")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = linked.join(least, "root").select("digest", "least")
    return sets, named.join(of_linked, "digest", "left").select("digest", F.coalesce("least", "first").alias("least"))


def open_members(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(number, n, shingles) of one document for each wanted set.

    A blocked Bloom filter of the wanted ids, of fixed size, spares most other
    texts the shuffle; the join decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            rows = []
            for d, number, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(1), k), strict=True):
                if digest(s) == d:  # not another row with the same id
                    rows.append((number, len(s), s.tobytes()))
            cols = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["number", "n", "shingles"])

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bits = bloom_table(wanted.select(F.coalesce(F.col("first_id").cast("string"), F.lit("null")).alias("canonical")))
    probed = texts.withColumn("block", bloom_block(name)).join(F.broadcast(bits), "block").filter(F.col("bits").bitwiseAND(bloom_mask(name)) == bloom_mask(name))
    rows = probed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "text", "number")
    return rows.mapInArrow(trimmed(run), "number long, n long, shingles binary").dropDuplicates(["number"])


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, leaf: int = LEAF, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One document of each component, the one with its least id, and all without
    a shingle. A row is met again by its doc_id and text; of linked rows with one
    id that with the least text digest stays, and one of equal rows."""
    with_package(docs.sparkSession)
    with scratch(docs.sparkSession):
        sets, of_set = _components(_texts(docs, id_col, text_col), k, percent, leaf, pivots, block)
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own") == F.col("least")
        rows = sets.join(of_set, "digest", "left").groupBy(id_key(F.col("doc_id")).alias("id"), "own").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_shingles") == 0).alias("empty"), F.max(F.coalesce(first, F.lit(False)).cast("long")).alias("first"))
        decided = keep(rows.select("id", "own", "rows", F.when(F.col("empty") > 0, F.col("rows")).otherwise(F.col("first")).alias("copies")), "jaccard-decided", outlives=True)
    return taken(docs, [id_key(F.col(id_col).cast("long")), text_digest(text_col)], decided)
