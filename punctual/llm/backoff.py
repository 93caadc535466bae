"""Stupid-backoff scores of documents against the rest of the corpus.

The probability of a word after its context is the share of the context's occurrences that
the word follows; where the longer n-gram occurs nowhere else, ``ALPHA`` times that of the
shorter context. A document's own occurrences are taken off every count, so each one is scored
by all others. N-grams do not cross documents.

The work is one relational plan on packed rows. Documents are exploded into n-grams chunk by
chunk (a few MB of text); a row holds a chunk's distinct n-grams of one hash range with their
counts, sorted and delta-coded, so a frequent n-gram comes once from each chunk. Rows are
grouped by hash range, where they add up to that part of the count table, and the table's part
is joined to the n-grams that asked: each row goes back with the total counts in its order. A
chunk's rows then meet its texts and are summed per document.

Nulls and edges: a null or empty text, or one without words, has no words, a total of zero and
no average. A word that no other document holds gets the share of half an occurrence. In a
table with one document all of its words are such. Rows are scored one by one: a repeated row
is another document. A table without rows gives none. Other columns are not read. The table is
read three times and must give the same rows in the same order, as stored files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import slices, text_column
from punctual.llm.packed import ascending_in, ascending_out, by_range, chunks, numbers_in, numbers_out, range_groups
from punctual.llm.words import MULTIPLIER, Words, mixed

ORDER = 3
ALPHA = 0.4
#: N-grams of a hash range on average (before equal ones are merged).
RANGE_NGRAMS = 2_000_000
HASH_BITS = np.uint64(~0xFF & (1 << 64) - 1)
#: No n-gram has hash zero.
LEAST_HASH = np.uint64(0x100)


class Chunk:
    """The n-grams of some texts: at every word the hash of each order's n-gram that ends
    there (0 where the text has fewer words before it)."""

    def __init__(self, texts: list[str | None], order: int):
        self.words = Words([(t or "").encode() for t in texts])
        text, n = self.words.text, len(self.words.first)
        # 55 bits of each hash are kept and sent: an n-gram shares its hash with one of n others with
        # a chance of n / 2**55.
        self.by_order = [mixed(self.words.hash ^ np.uint64(1)) & HASH_BITS | LEAST_HASH]
        for k in range(1, order):
            grams = np.zeros(n, np.uint64)
            longer = mixed(self.by_order[k - 1][:-1] * MULTIPLIER + self.words.hash[1:]) & HASH_BITS | LEAST_HASH
            whole = np.zeros(n, bool)
            whole[k:] = text[k:] == text[: n - k] if n > k else False
            grams[1:] = longer
            self.by_order.append(np.where(whole, grams, np.uint64(0)))
        # All orders in one ascending list; zero stands for none.
        self.grams, self.places = np.unique(np.concatenate(self.by_order), return_inverse=True)
        self.times = np.bincount(self.places, minlength=len(self.grams))
        skip = int(len(self.grams) > 0 and self.grams[0] == 0)
        self.asked, self.asked_times, self.skip = self.grams[skip:], self.times[skip:], skip
        self.places = self.places.reshape(order, n)

    def scores(self, totals: np.ndarray, all_words: int, alpha: float, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and summed log scores of each text, given the corpus count of ``asked``."""
        n = len(self.words.first)
        sums, sizes = np.zeros(texts), np.diff(self.words.bounds)
        if not n:
            return sizes, sums
        totals = np.append(np.zeros(self.skip, np.int64), totals)
        text = self.words.text
        rest = []
        for k, place in enumerate(self.places):
            # Corpus count less the text's own.
            pairs, back, own = np.unique(text * len(self.grams) + place, return_inverse=True, return_counts=True)
            left = totals[place] - own[back]
            rest.append(np.where(self.by_order[k] == 0, 0, left) if k else left)
        others = np.maximum(all_words - sizes[text], 1).astype(float)
        share = np.maximum(rest[0], 0.5) / others * alpha ** (len(rest) - 1)
        for k in range(1, len(rest)):
            context = np.append(0, rest[k - 1][:-1])
            # The context of an n-gram is the shorter n-gram that ends one word before. Longer
            # matches take the place of shorter ones.
            hit = (rest[k] > 0) & (context > 0)
            share = np.where(hit, rest[k] / np.maximum(context, 1) * alpha ** (len(rest) - 1 - k), share)
        np.add.at(sums, text, np.log(share))
        return sizes, sums


def _ask(order: int, ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in chunks(batches):
            chunk = Chunk(batch.column("text").to_pylist(), order)
            rows = by_range(chunk.asked, ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _, _ in rows], pa.int64()),
                pa.array([number] * len(rows), pa.int64()),
                pa.array([b - a for _, a, b in rows], pa.int64()),
                pa.array([ascending_out(chunk.asked[a:b]) for _, a, b in rows], pa.binary()),
                pa.array([numbers_out(chunk.asked_times[a:b]) for _, a, b in rows], pa.binary()),
            ], ["range", "chunk", "n", "grams", "counts"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: add up the counts, give each row the totals of its n-grams."""
    sizes = table.column("n").to_pylist()
    grams = [ascending_in(g.as_py(), n) for g, n in zip(table.column("grams"), sizes)]
    own = [numbers_in(c.as_py(), n) for c, n in zip(table.column("counts"), sizes)]
    known, places = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.zeros(len(known), np.int64)
    np.add.at(totals, places, np.concatenate(own).astype(np.int64))
    ends = np.cumsum(sizes).tolist()
    back = [numbers_out(totals[places[e - n : e]]) for e, n in zip(ends, sizes)]
    return pa.table({
        "chunk": table.column("chunk"), "range": table.column("range"), "n": table.column("n"),
        "counts": pa.array(back, pa.binary()),
        "ids": pa.nulls(len(back), pa.list_(pa.int64())),
    })


ANSWER = "chunk long, range long, n long, counts binary, ids array<long>"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, batch in chunks(batches):
        # A zero byte is in no word, so it can stand between texts.
        joined = "\0".join((t or "").replace("\0", " ") for t in batch.column("text").to_pylist())
        packed = zstandard.ZstdCompressor(level=3).compress(joined.encode())
        ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([-1], pa.int64()), pa.array([batch.num_rows], pa.int64()),
            pa.array([packed], pa.binary()), ids,
        ], ["chunk", "range", "n", "counts", "ids"])


def _sum(order: int, all_words: int, alpha: float):
    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        first = table.slice(0, 1).to_pylist()[0]
        texts = zstandard.ZstdDecompressor().decompress(first["counts"]).decode().split("\0")
        chunk = Chunk(texts, order)
        rest = table.slice(1)
        counts = [numbers_in(c.as_py(), n) for c, n in zip(rest.column("counts"), rest.column("n").to_pylist())]
        sizes, sums = chunk.scores(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64), all_words, alpha, len(texts))
        return pa.table({
            "doc_id": pa.array(first["ids"], pa.int64()), "n_words": pa.array(sizes.astype(np.int64)),
            "log_score": pa.array(sums),
        })

    return total


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = len(Words([(t or "").encode() for t in batch.column("text").to_pylist()], hashes=False).first)
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64())], ["words"])


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_words, log_score`` (the sum) and ``per_word`` of every row."""
    rows = text_column(docs).withColumn("text", F.col("text").cast("string")).withColumn("part", F.spark_partition_id())
    words = rows.select("text").mapInArrow(_measure, "words long").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    ranges = max(1, -(-words * order // RANGE_NGRAMS))
    asked = rows.mapInArrow(_ask(order, ranges), "range long, chunk long, n long, grams binary, counts binary")
    answers = range_groups(asked, ranges).applyInArrow(_answer, ANSWER)
    texts = rows.mapInArrow(_texts, ANSWER)
    summed = answers.unionByName(texts).groupBy("chunk").applyInArrow(
        _sum(order, words, alpha), "doc_id long, n_words long, log_score double"
    )
    return summed.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
