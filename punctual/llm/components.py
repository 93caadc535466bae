"""Connected components of a graph given as pairs, by alternating large and small stars.

Every round moves links towards the smallest id of a neighbourhood: a large star links all
larger neighbours of a node to the smallest one, a small star all smaller ones. The number
of links never grows, a hub's links are handled row by row (its smallest neighbour comes from
a pre-aggregated minimum), and a component of any shape ends as a star in few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import stored

MOST_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as stars around their smallest ids: fewer rows, same components."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = places[: len(a)], places[len(a) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        own = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[own]]), pa.array(ids[own])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id that occurs in ``links`` (``a, b``, long), where
    ``component`` is the smallest id reachable. Nulls and loops link nothing."""
    spark = links.sparkSession
    links = links.filter("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    links = stored(links.mapInArrow(_forest, "a long, b long").distinct(), "links")
    rows = _mark(links)
    for _ in range(MOST_ROUNDS):
        if rows[0] == 0:
            return spark.createDataFrame([], "id long, component long")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        # Every link now goes from a smaller to a larger id.
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(least, "b").select(
            F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("link")
        ).select("link.*").filter("a <> b").distinct()
        links = stored(small, "links")
        before, rows = rows, _mark(links)
        if rows == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """Changes whenever a link does."""
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
