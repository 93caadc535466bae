"""Benchmark passages in documents, found by Wu-Manber search.

A pattern is a window of consecutive words of a benchmark item. Texts and items are reduced
to their words with one space between, so a pattern occurs at a word where its bytes do.

Patterns of one length m (in words) are searched together. For each pair of neighbouring
words (the block) of any pattern, the shift table holds how far the search may move on when
the block ends the current position: a block in no pattern moves it m - 1 words on. Where the
shift is zero, the block's hash and that of the first block name a bucket of patterns,
whose bytes are compared with the text. Thousands of places of a text are searched at a time.

Nulls and edges: a null or empty text, or one without words, has no words and no hit. Items
that are null or without words have no window; an item of fewer words than a window is one
window. Equal items are all reported. A null ``item_id`` is not reported, its windows hit. A table
of documents without rows gives none; an empty benchmark hits nothing. Repeated rows are
judged alike, each for itself. Other columns are kept out of the search.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from punctual.llm.common import slices, stored
from punctual.llm.words import MULTIPLIER, Words, mixed, plain_words

#: Words of a window.
WINDOW = 10
#: Benchmark text searched in one pass over the documents (about a hundred times as much
#: memory in tables); more text takes further passes, so what is broadcast stays bounded.
BLOCK_BYTES = 1 << 20
SHIFT_BITS = 20
#: A place of the text starts its own search every so many words.
LANE = 512

def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * MULTIPLIER + hashes[1:])


class Patterns:
    """Shift and bucket tables for the windows of some items, by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.by_length: dict[int, tuple] = {}
        owners: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            kept = plain_words((text or "").encode())
            size = min(window, len(kept))
            for i in range(len(kept) - size + 1 if size else 0):
                own = owners[size][b" ".join(kept[i : i + size])]
                if item is not None and item not in own:
                    own.append(item)
        for size, found in sorted(owners.items()):
            texts = list(found)
            words = Words(texts)
            hashes = words.hash.reshape(len(texts), size)
            # A window of one word is its own block.
            blocks = np.stack([_pairs(h) for h in hashes]) if size > 1 else hashes
            last = blocks.shape[1] - 1
            shifts = np.full(1 << SHIFT_BITS, last + 1, np.uint8 if last < 255 else np.int64)
            for i in range(last + 1):
                np.minimum.at(shifts, (blocks[:, i] & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int64), last - i)
            buckets: dict[int, list[int]] = defaultdict(list)
            for p, key in enumerate((blocks[:, last] ^ (blocks[:, 0] << np.uint64(1))).tolist()):
                buckets[key].append(p)
            self.by_length[size] = (shifts, dict(buckets), np.array(sorted(buckets), np.uint64), texts, [found[t] for t in texts])

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """``(first word, number of words, items)`` of each occurrence."""
        n = len(words.first)
        for size, (shifts, buckets, keys, texts, items) in self.by_length.items():
            if n < size:
                continue
            blocks = _pairs(words.hash) if size > 1 else words.hash
            last = max(size - 2, 0)
            # Lanes: each searches the windows that begin in its part of the words.
            begins = np.arange(0, n - size + 1, LANE)
            stops = np.minimum(begins + LANE, n - size + 1)
            at, stop = begins.copy(), stops
            slot = (blocks & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int32)
            places = []
            while len(at):
                step = shifts[slot[at + last]].astype(np.int64)
                zero = step == 0
                places.append(at[zero])
                at = at + np.maximum(step, 1)
                on = at < stop
                at, stop = at[on], stop[on]
            places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
            places = places[words.text[places] == words.text[places + size - 1]]
            key = blocks[places + last] ^ (blocks[places] << np.uint64(1))
            named = np.isin(key, keys)
            for place, k in zip(places[named].tolist(), key[named].tolist()):
                own = [words.raw[a:b] for a, b in zip(words.first[place : place + size].tolist(), words.last[place : place + size].tolist())]
                whole = b" ".join(own)
                for p in buckets[k]:
                    if texts[p] == whole:
                        yield place, size, items[p]


def _blocks(items: DataFrame, most_bytes: int) -> Iterator[list]:
    """The benchmark in blocks of bounded size, one at a time. It is the query set: small beside the
    documents, read once."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len((row["text"] or "").encode())
        if held and held + size > most_bytes:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    yield block


FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64())]))),
])
FOUND_SQL = (
    "struct<n_words: long, n_hit: long, items: array<long>, spans: array<struct<word: long, words: long>>>"
)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
         block_bytes: int = BLOCK_BYTES, column: str = "found") -> DataFrame:
    """The rows of ``docs`` with a struct ``column``: ``n_words``, the hit words as runs
    ``spans`` of (first word, words), their number ``n_hit``, and ``items``, whose windows occur."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = _blocks(items, block_bytes)
    first, second = next(blocks), next(blocks, None)
    own, none = F.col(f"`{text}`").cast("string"), F.lit(None).cast(FOUND_SQL)

    def judge(block: list, earlier: Column) -> Column:
        return F.arrow_udf(_search(spark.sparkContext.broadcast(Patterns(block, window))), FOUND_SQL)(own, earlier)

    if second is None:
        return docs.withColumn(column, judge(first, none))
    # Several passes read the texts of one stored table; each writes the hits it found alone.
    keyed = stored(docs.withColumn("__key", F.monotonically_increasing_id()), "to-search")
    hits = None
    for block in chain([first, second], blocks):
        found = keyed.select("__key", judge(block, none).alias("__own")).filter(F.size("__own.spans") > 0)
        part = stored(found.select("__key", "__own.spans", "__own.items"), "hits")
        hits = part if hits is None else hits.unionByName(part)
    earlier = F.struct(
        F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("n_hit"),
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    joined = keyed.join(hits.groupBy("__key").agg(earlier.alias("__earlier")), "__key", "left")
    return joined.withColumn(column, judge([], F.col("__earlier"))).drop("__key", "__earlier")


def _search(table):
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, earlier in batches:
            both = pa.RecordBatch.from_arrays([texts, earlier], ["text", "earlier"])
            rows = []
            for part in slices([both]):
                words = Words([(t or "").encode() for t in part.column("text").to_pylist()])
                rows += _judge(words, part.column("earlier").to_pylist(), table.value)
            yield pa.array(rows, FOUND)

    return search


def _judge(words: Words, earlier: list[dict | None], table: Patterns) -> list[dict]:
    """Each text's hits, joined with those that an earlier pass found."""
    edges = words.bounds.tolist()
    hit = np.zeros(len(words.first) + 1, np.int32)
    items: dict[int, set[int]] = defaultdict(set)

    def mark(first: int, size: int) -> None:
        hit[first] += 1
        hit[first + size] -= 1

    for place, size, own in table.hits(words):
        mark(place, size)
        items[int(words.text[place])].update(own)
    for i, before in enumerate(earlier):
        for span in before["spans"] if before else ():
            mark(edges[i] + span["word"], span["words"])
        if before and before["items"]:
            items[i].update(before["items"])
    inside = np.cumsum(hit[:-1]) > 0
    marked = set(words.text[inside].tolist())
    rows = []
    for i in range(len(earlier)):
        own = inside[edges[i] : edges[i + 1]]
        turns = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist() if i in marked else []
        rows.append({
            "n_words": len(own),
            "n_hit": int(own.sum()) if i in marked else 0,
            "items": sorted(items.get(i, ())),
            "spans": [{"word": x, "words": y - x} for x, y in zip(turns[::2], turns[1::2])],
        })
    return rows


def digest(found: DataFrame, column: str = "found") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of rows with ``found``."""
    names = F.array_join(F.array_sort(F.transform(f"{column}.items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"{column}.n_words").alias("n_words"),
        F.col(f"{column}.n_hit").alias("n_hit"),
        F.size(f"{column}.items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col(f"{column}.n_hit") > 0).alias("contaminated"),
    )
