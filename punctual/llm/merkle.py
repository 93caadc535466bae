"""Merkle manifest of a table: digests, roots and proofs by time-forward processing.

Leaves stand in order of their document in the tree of their source; runs of ``FANOUT`` nodes
become one node until one is left, and the roots of all sources form a tree in the same way.
Every node has a label, larger than those of its children: its level, then its place.

Going up, a priority queue ordered by label delivers digests to parents. The sweep takes the
smallest label, pops the digests sent to it, hashes them and sends the result on. The queue's
near end is a heap for ``FANOUT ** DEPTH`` neighbouring nodes, its far end is on disk: the
digest that leaves such a block is written, and a shuffle deals out and sorts what was written
by tree and place for the sweep of the levels above. So a task holds one block at a time, and
the tables shrink by ``FANOUT ** DEPTH`` each time.

Going down, the sweep runs from the largest label to the smallest. Each node gets the part of
the proof above it, puts its own run before it and sends the result to its children. Blocks
compute the digests inside them again and only send what reaches their lowest nodes.

Nulls and edges: every null value is hashed as ``-``. Rows without a source are a source of
their own, before all others; rows without ``doc_id`` come first in theirs and are never
tampered with. Rows with the same ``doc_id`` stand in the order of their leaves (equal leaves in
any order: nothing tells them apart). A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.llm.common import rows_in, stored

FANOUT = 16
#: Levels that one sweep climbs: a block has FANOUT ** DEPTH nodes at most.
DEPTH = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes: int, fanout: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def climb(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The digests of each level of a block, lowest first. Messages are ``(label, child's
    label, digest)``, and the queue gives them in the order in which they are needed."""
    queue = [((0, place), None, own) for place, own in enumerate(digests)]
    heapq.heapify(queue)
    out: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        label = queue[0][0]
        received = []
        while queue and queue[0][0] == label:
            received.append(heapq.heappop(queue)[2])
        level, place = label
        own = digest(received) if level else received[0]
        out[level].append(own)
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // fanout), label, own))
    return out


def descend(table: list[list[str]], above: bytes, fanout: int) -> Iterator[tuple[int, bytes]]:
    """The place of each lowest node and the part of its proof from its own run up. Labels are
    taken from the largest down, so that a node's part is there before it is passed on."""
    top = len(table) - 1
    queue = [((-top, 0), above)]
    while queue:
        (level, place), own = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            yield place, own
            continue
        first = place * fanout
        run = table[level - 1][first : first + fanout]
        plain = bytes.fromhex("".join(run))
        for child in range(len(run)):
            heapq.heappush(queue, ((1 - level, -(first + child)), bytes([len(run), child]) + plain + own))


def steps(proof: bytes) -> Iterator[tuple[int, list[str]]]:
    """The runs of a proof from the leaf up: the own place in each and all its digests."""
    at = 0
    while at < len(proof):
        n, own = proof[at], proof[at + 1]
        run = [proof[at + 2 + 32 * i : at + 34 + 32 * i].hex() for i in range(n)]
        yield own, run
        at += 2 + 32 * n


def prove(leaf: str, proof: bytes) -> tuple[str, str]:
    """The digest of all siblings, and the root that the leaf gives with them."""
    siblings = sha256()
    for own, run in steps(proof):
        siblings.update("".join(run[:own] + run[own + 1 :]).encode())
        leaf = digest([*run[:own], leaf, *run[own + 1 :]])
    return siblings.hexdigest(), leaf


# --- leaves ------------------------------------------------------------------
def leaf_of(fields: list[Column]) -> Column:
    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[shown(f) for f in fields]), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows (stored) with ``tree_rows``, the number of rows of their tree, and ``place``, their
    own from 0 on. The rows are sorted by ranges; only one row per tree and range is totalled."""
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()
    sorted_rows = stored(
        rows.repartitionByRange(rows_in(spark), tree, *order).sortWithinPartitions(tree, *order)
        .withColumns({"__part": F.spark_partition_id(), "__row": number}),
        "sorted",
    )
    # A partition's numbers are consecutive; a tree has one run of rows in each.
    parts = sorted_rows.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__row").alias("__first"))
    within = Window.partitionBy(tree)
    earlier = within.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col(tree).alias("__tree"), F.col("__part").alias("__own"),
        F.sum("__rows").over(within).alias("tree_rows"),
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__own"))
    return sorted_rows.join(parts, same).withColumn("place", F.col("__row") + F.col("__shift")).drop(
        "__part", "__row", "__own", "__tree", "__shift"
    )


# --- sweeps ------------------------------------------------------------------
def _table(group: pa.Table, total: int, block: int, fanout: int, depth: int) -> tuple[pa.Table, list[list[str]]]:
    group = group.sort_by("place")
    levels = min(depth, levels_above(total, fanout))
    return group, climb(group.column("digest").to_pylist(), levels, fanout)


def _up(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The highest nodes of all blocks of ``tree, tree_rows, place, digest``, in the same columns."""
    size = fanout**depth

    def sweep(key, group):
        tree, block = key[0].as_py(), key[1].as_py()
        total = group.column("tree_rows")[0].as_py()
        _, table = _table(group, total, block, fanout, depth)
        return pa.table({
            "tree": pa.array([tree], pa.int64()), "tree_rows": pa.array([-(-total // size)], pa.int64()),
            "place": pa.array([block], pa.int64()), "digest": [table[-1][0]],
        })

    blocks = nodes.withColumn("block", F.expr(f"place div {size}"))
    return blocks.groupBy("tree", "block").applyInArrow(sweep, "tree long, tree_rows long, place long, digest string")


def _down(nodes: DataFrame, above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``tree, place, proof`` for the lowest nodes of all blocks; ``above`` has the highest ones'."""
    size = fanout**depth

    def sweep(key, group, top):
        tree, block = key[0].as_py(), key[1].as_py()
        group, table = _table(group, group.column("tree_rows")[0].as_py(), block, fanout, depth)
        found = sorted(descend(table, top.column("proof")[0].as_py(), fanout))
        return pa.table({
            "tree": pa.array([tree] * len(found), pa.int64()),
            "place": pa.array([block * size + place for place, _ in found], pa.int64()),
            "proof": pa.array([proof for _, proof in found], pa.binary()),
        })

    blocks = nodes.withColumn("block", F.expr(f"place div {size}"))
    tops = above.withColumnRenamed("place", "block")
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(
        sweep, "tree long, place long, proof binary"
    )


def _sweeps(nodes: DataFrame, largest: int, fanout: int, depth: int) -> list[DataFrame]:
    """``nodes`` and the stored tables of the nodes above them, up to one node per tree."""
    tables = [nodes.select("tree", "tree_rows", "place", "digest")]
    while largest > 1:
        tables.append(stored(_up(tables[-1], fanout, depth), "merkle-nodes"))
        largest = math.ceil(largest / fanout**depth)
    return tables


def manifest(docs: DataFrame, fields: list[str] = FIELDS, id_column: str = "doc_id", source: str = "source",
             text: str = "text", fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    The tampered copy of a document, made where 5 divides the crc32 of its id, has a text in
    lower case; ``folded_root`` is computed from its leaf and the siblings of the original.
    """
    own = lambda name: F.col(f"`{name}`")
    lower = F.translate(own(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(own(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(
        own(id_column).cast("long").alias("doc_id"), own(source).alias("source"), leaf_of([own(f) for f in fields]).alias("leaf"),
        F.when(tampered, leaf_of([lower if f == text else own(f) for f in fields])).alias("other"),
    )
    placed = ranked(rows, "source", ["doc_id", "leaf"])
    # The trees of the sources are numbered in their order.
    sources = stored(
        ranked(placed.filter("place = 0").select("source", "tree_rows").withColumnRenamed("tree_rows", "size")
               .withColumn("all", F.lit(0)), "all", ["source"]), "sources",
    )
    largest = sources.agg(F.max("size"), F.count(F.lit(1))).first()
    if not largest[1]:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    numbered = sources.select(F.col("source").alias("__source"), F.col("place").alias("tree"))
    nodes = stored(
        placed.join(numbered, F.col("source").eqNullSafe(F.col("__source")))
        .select("doc_id", "leaf", "other", "tree", "tree_rows", "place"), "leaves",
    )
    trees = _sweeps(nodes.withColumnRenamed("leaf", "digest"), largest[0], fanout, depth)
    subroots = trees[-1].select("tree", F.col("digest").alias("subroot"))
    roots = _sweeps(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(largest[1]).cast("long").alias("tree_rows"),
        F.col("tree").alias("place"), F.col("subroot").alias("digest"),
    ), largest[1], fanout, depth)
    root = roots[-1].select("digest").first()[0]

    proofs = roots[-1].select("tree", "place", F.lit(b"").alias("proof"))
    for table in reversed(roots[:-1]):
        proofs = stored(_down(table, proofs, fanout, depth), "proofs")
    proofs = proofs.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "proof")
    for table in reversed(trees[1:-1]):
        proofs = stored(_down(table, proofs, fanout, depth), "proofs")
    tops = proofs.withColumnRenamed("place", "block").join(subroots, "tree")
    size = fanout**depth

    def verify(key, group, top):
        group, table = _table(group, group.column("tree_rows")[0].as_py(), key[1].as_py(), fanout, depth)
        found = [proof for _, proof in sorted(descend(table, top.column("proof")[0].as_py(), fanout))]
        leaves, others = group.column("digest").to_pylist(), group.column("other").to_pylist()
        ends = [prove(other or leaf, proof) for leaf, other, proof in zip(leaves, others, found)]
        n = group.num_rows
        return pa.table({
            "doc_id": group.column("doc_id"), "leaf": group.column("digest"),
            "subroot": pa.array([top.column("subroot")[0].as_py()] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array([a for a, _ in ends], pa.string()), "folded_root": pa.array([b for _, b in ends], pa.string()),
            "verified": pa.array([b == root for _, b in ends], pa.bool_()),
        })

    blocks = nodes.withColumnRenamed("leaf", "digest").withColumn("block", F.expr(f"place div {size}"))
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(
        verify,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


# --- the same in SQL ---------------------------------------------------------
#: Levels that the SQL has: trees of FANOUT ** SQL_LEVELS leaves.
SQL_LEVELS = 6


def _sql_leaf(text: str) -> str:
    fields = ["d.doc_id", "source", "lang", "n_chars", text]
    shown = [f"coalesce(concat(octet_length(encode(cast({f} AS varchar))), ':', cast({f} AS varchar)), '-')" for f in fields]
    return f"sha256(concat({', '.join(shown)}))"


def _sql_climb(prefix: str, first: str, fanout: int, levels: int) -> list[str]:
    """Tables ``prefix0`` to ``prefix<levels>`` of (tree, place, n, digest), the next one of each
    with one node for every run, or the same single node."""
    out = [f"{prefix}0 AS ({first})"]
    for level in range(1, levels + 1):
        out.append(f"""{prefix}{level} AS (
            SELECT tree, place // {fanout} AS place, max((n + {fanout - 1}) // {fanout}) AS n,
                   CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
            FROM {prefix}{level - 1} GROUP BY tree, place // {fanout})""")
    return out


def _sql_siblings(prefix: str, fanout: int, levels: int) -> list[str]:
    """Tables of (tree, place, before, after): a node's siblings on either side, none for a root."""
    window = f"OVER (PARTITION BY tree, place // {fanout} ORDER BY place ROWS BETWEEN"
    return [f"""{prefix}{level}_sides AS (
        SELECT tree, place, n > 1 AS hashed,
               coalesce(string_agg(digest, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
        FROM {prefix}{level})""" for level in range(levels)]


def oracle(fanout: int = FANOUT, levels: int = SQL_LEVELS) -> str:
    """``manifest`` of ``documents`` in SQL, level by level."""
    # crc32 bit by bit: DuckDB has none.
    bits = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    step = "xor(c, ascii(substr(digits, k, 1)))"
    names = [f"t{level}" for level in range(levels)] + [f"r{level}" for level in range(levels)]
    folds, joins, own = [], [], "coalesce(other, leaf)"
    for name in names:
        tree = "l.tree" if name[0] == "t" else "0"
        place = f"l.place // {fanout ** int(name[1:])}" if name[0] == "t" else f"l.tree // {fanout ** int(name[1:])}"
        joins.append(f"JOIN {name}_sides {name} ON {name}.tree = {tree} AND {name}.place = {place}")
        folds.append((name, f"CASE WHEN {name}.hashed THEN sha256(concat({name}.before, {{0}}, {name}.after)) ELSE {{0}} END"))
    # One column after the other, as each one needs the one before it.
    columns = []
    for i, (name, fold) in enumerate(folds):
        columns.append(f"{fold.format(own)} AS f{i}")
        own = f"f{i}"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        f"""crcs AS (
        WITH RECURSIVE steps(doc_id, digits, k, bit, c) AS (
            SELECT doc_id, cast(doc_id AS varchar), 1, 0, cast(4294967295 AS bigint) FROM documents WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT doc_id, digits, CASE WHEN bit = 8 THEN k + 1 ELSE k END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
                   CASE bit WHEN 0 THEN {step} ELSE {bits} END
            FROM steps WHERE k <= length(digits))
        SELECT DISTINCT doc_id, xor(c, 4294967295) AS crc FROM steps WHERE k > length(digits))""",
        f"""leaves AS (
        SELECT d.doc_id, source, {_sql_leaf('text')} AS leaf,
               CASE WHEN crc % 5 = 0 THEN {_sql_leaf(lower)} END AS other
        FROM documents d LEFT JOIN crcs ON d.doc_id = crcs.doc_id)""",
        """trees AS (
        SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree, count(*) AS n
        FROM leaves GROUP BY source)""",
        """placed AS (
        SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
        FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source)""",
        *_sql_climb("t", "SELECT tree, place, n, leaf AS digest FROM placed", fanout, levels),
        *_sql_siblings("t", fanout, levels),
        *_sql_climb("r", f"SELECT 0 AS tree, tree AS place, (SELECT count(*) FROM trees) AS n, digest FROM t{levels}", fanout, levels),
        *_sql_siblings("r", fanout, levels),
        f"""folded AS (
        SELECT l.doc_id, l.leaf, l.tree, {', '.join(columns)},
               sha256(concat({', '.join(f'{n}.before, {n}.after' for n in names)})) AS proof_sha256
        FROM placed l {' '.join(joins)})""",
    ]
    return f"""WITH {', '.join(tables)}
        SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, proof_sha256, {own} AS folded_root, {own} = r.digest AS verified
        FROM folded JOIN t{levels} t ON t.tree = folded.tree CROSS JOIN r{levels} r"""
