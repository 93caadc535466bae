"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are chosen from a bounded sample of the vectors, each as far as can be
from those before it; their number grows with the table, up to a bound. A vector is described by its
``NEAREST`` pivots in order of distance. Two vectors are candidates if they share two pivots or
more, whatever the order. So the inverted lists are those of pairs of pivots: a vector is
listed under every two of its pivots, lists are counted without vectors, and a list of one
vector has no candidates. Only then the vectors are brought to their lists and verified by cosine in double
precision. A pair of vectors is counted in the list of the lowest two pivots that both share,
and every pair that is verified there links.

Vectors of a length for which the sample gives fewer than ``NEAREST`` pivots are one list, each
pair of which is a candidate. Long lists are cut into blocks of ``BLOCK`` vectors, pairs of which are
compared as matrices, short ones are dealt out together: no pair leaves its task, only link counts and
the links of a forest. Vectors that agree in every component are one entry with a number of
copies. Only the pivots come from a sample; all vectors are listed.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do vectors of different lengths. Rows of one ``vec_id`` are vectors of their
own that fall into one component. A row without ``vec_id`` links with nothing. A table without
rows gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import join_spread, stored
from punctual.llm.components import components

LEAST = 0.9
#: Vectors for each pivot, and the bounds of their number: they lie on the driver and in each task.
PER_PIVOT, PIVOTS, MOST_PIVOTS = 64, 1024, 8192
#: Sampled vectors for each pivot.
SAMPLE = 4
NEAREST = 8
BLOCK = 256
#: Listed vectors that are dealt out together.
DEALT = 2_000
#: Similarities to pivots that a task holds at once.
CELLS = 1 << 20


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one least like all before it."""
    sample = _unit(sample)
    chosen, like = [0], sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        chosen.append(int(like.argmin()))
        like = np.maximum(like, sample @ sample[chosen[-1]])
    return sample[chosen]


def _usable():
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & whole & F.exists("embedding", lambda x: x != 0)
    )


def _describe(pivots: dict[int, np.ndarray]):
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum([len(v) for v in vectors])
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            out: list = [None] * len(vectors)
            for size in set((ends - starts).tolist()):
                rows = np.flatnonzero(ends - starts == size)
                if size not in pivots:
                    # Lengths without pivots enough are rare: one list for each, compared exactly.
                    for r in rows.tolist():
                        out[r] = [-size]
                    continue
                # Some rows at a time, so that memory does not grow with both rows and pivots.
                step = max(1, CELLS // len(pivots[size]))
                for part in (rows[at : at + step] for at in range(0, len(rows), step)):
                    own = _unit(flat[starts[part][:, None] + np.arange(size)])
                    near = np.argsort(-(own @ pivots[size].T), axis=1, kind="stable")[:, :NEAREST]
                    for r, p in zip(part.tolist(), near.tolist()):
                        out[r] = p
            yield pa.array(out, pa.list_(pa.int32()))

    return describe


COUNTED = "code long, first long, root long, links long"
NONE = -(1 << 30)


def _lowest_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The two smallest pivots that each row of x shares with the same row of y (ascending)."""
    same = (x[:, :, None] == y[:, None, :]).any(2) & (x != NONE)
    return np.sort(np.where(same, x, 1 << 30), axis=1)[:, :2]


def _compare(least: float):
    def compare(table):
        table = table.sort_by([("p", "ascending"), ("q", "ascending")])
        p, q, block = (table.column(c).to_numpy() for c in ("p", "q", "block"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        code, first, copies = (table.column(c).to_numpy() for c in ("code", "first", "copies"))
        lists = table.column("embedding").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        near = np.full((len(code), NEAREST), NONE, np.int64)
        for i, own in enumerate(table.column("near").to_pylist()):
            near[i, : len(own)] = own
        begins = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))).tolist()
        pairs = []
        for a, b in zip(begins, [*begins[1:], len(code)]):
            if b - a < 2:
                continue
            # The vectors of a list have one length: so have those of its pivots.
            vectors = _unit(flat[offsets[a] : offsets[b]].reshape(b - a, -1))
            left, right = np.arange(b - a), np.arange(b - a)
            if low >= 0:
                left, right = np.flatnonzero(block[a:b] == low), np.flatnonzero(block[a:b] == high)
            x, y = np.nonzero(vectors[left] @ vectors[right].T >= least)
            x, y = left[x] + a, right[y] + a
            if low == high:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 20_000):
                i, j = x[at : at + 20_000], y[at : at + 20_000]
                if p[a] >= 0:
                    shared = _lowest_two(near[i], near[j])
                    here = (shared[:, 0] == p[a]) & (shared[:, 1] == q[a])
                    i, j = i[here], j[here]
                pairs.append((i, j))
        # A vector is in several lists of a task: its links are added up by its code.
        codes, own, place = np.unique(code, return_index=True, return_inverse=True)
        out, root = np.zeros(len(codes), np.int64), np.arange(len(codes))
        if pairs:
            i, j = (np.concatenate(side) for side in zip(*pairs))
            np.add.at(out, place[i], copies[j])
            np.add.at(out, place[j], copies[i])
            i, j = place[i], place[j]
            while True:
                new = root.copy()
                below = np.minimum(root[i], root[j])
                np.minimum.at(new, root[i], below)
                np.minimum.at(new, root[j], below)
                new = new[new]
                if (new == root).all():
                    break
                root = new
        linked, firsts = out > 0, first[own]
        return pa.table({"code": codes[linked], "first": firsts[linked], "root": firsts[root[linked]], "links": out[linked]})

    return compare


def near_duplicates(vectors: DataFrame, least: float = LEAST, pivots: int | None = None, sample: int = SAMPLE,
                    block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``. ``pivots`` are one for
    ``PER_PIVOT`` vectors within bounds, ``sample`` times as many vectors are read to choose them."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(_usable(), F.lit(False)))
    entries = (
        rows.filter("usable").groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("code", F.xxhash64("embedding"))
    )
    entries = stored(entries, "vectors")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, entries.count() // PER_PIVOT))
    # The sample: a bounded number of rows, those with the smallest codes.
    taken = [r[0] for r in entries.orderBy("code", "first").select("embedding").limit(sample * pivots).collect()]
    chosen = {
        size: far_apart(np.array([v for v in taken if len(v) == size]), pivots) for size in {len(v) for v in taken}
    }
    # Of fewer pivots every vector would list all, and of one alone no pair would share two.
    chosen = {size: own for size, own in chosen.items() if len(own) >= NEAREST}
    describe = F.arrow_udf(_describe(chosen), "array<int>")
    described = stored(entries.withColumn("near", F.array_sort(describe("embedding"))), "described")
    two = F.transform("near", lambda x, i: F.transform(
        F.filter("near", lambda y, j: (j > i) | (x < 0)), lambda y: F.struct(x.alias("p"), y.alias("q"))
    ))
    listed = described.select("code", F.explode(F.flatten(two)).alias("own")).select("code", "own.*")
    counts = stored(listed.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    # Short lists together, each block of a long one with each other block.
    bins = max(1, -(-int(counts.agg(F.sum("n")).first()[0] or 0) // DEALT))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.col("code"), blocks).cast("int")).otherwise(-1)
    others = F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))
    met = join_spread(listed, counts, ["p", "q"], "code").select(
        "code", "p", "q", own.alias("block"), F.explode(others).alias("other"),
        F.when(blocks > 1, F.xxhash64("p", "q")).otherwise(F.pmod(F.xxhash64("p", "q"), F.lit(bins))).alias("bin"),
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    counted = stored(
        met.join(described, "code")
        .groupBy("bin", "low", "high").applyInArrow(_compare(least), COUNTED), "counted"
    )
    links = counted.groupBy("code").agg(F.sum("links").alias("links"))
    several = rows.filter("usable").groupBy("vec_id").count().filter("count > 1").select("vec_id")
    same_id = rows.filter("usable").join(several, "vec_id").join(entries.select("embedding", "first"), "embedding")
    joined = components(
        counted.select(F.col("root").alias("a"), F.col("first").alias("b"))
        .unionByName(same_id.select(F.col("first").alias("a"), F.col("vec_id").alias("b")))
    )
    known = (
        entries.join(links, "code", "left").join(joined.withColumnRenamed("id", "first"), "first", "left")
        .select("code", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "first").alias("component"))
    )
    coded = rows.select("vec_id", F.when(F.col("usable"), F.xxhash64("embedding")).alias("code"))
    found = coded.join(known, "code", "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
