"""Repeated passages removed by sliding spans of sentences.

A text is cut into sentences (at line breaks, and after ``.``, ``!`` or ``?`` before white
space). Every run of ``sentences`` consecutive sentences is hashed, however short they are (longer
runs are covered by these); a sentence of ``long_words`` words is a run by itself. With a floor of
``words`` words, off by default, the shortest runs that reach it from and to every sentence are hashed. Runs with equal hashes (96 bits) anywhere
in the table are one span; its first occurrence, by ``doc_id`` and place, stays. Every sentence
covered by an occurrence that is not the first is removed with the white space after it.

Runs that occur once leave the job early: counts and first places are taken before the shuffle,
and only runs with a count above one are joined back to their places. A very frequent one
is dealt out over several tasks.

Nulls and edges: a null text stays null, an empty one empty; neither has sentences. Texts of
fewer sentences than a run have none. Rows equal in ``doc_id`` and text are one
document: no repeat of one another, treated alike. A null ``doc_id`` comes after all others.
A table without rows gives none. Other columns are kept; names that begin with two underscores
are the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import rows_in, slices, stored

SENTENCES = 2
#: No floor: a repeated run of short sentences is a repeat as well.
WORDS = 0
LONG_WORDS = 40
#: A very frequent run is cut into this many pieces for each partition that it would fill.
CUTS = 4
BREAK = re.compile(r"\n+|(?<=[.!?])\s+")
RUNS = "hash long, check int, doc_id long, row long, pos int, size int"
REMOVED = "struct<text: string, n_sentences: long, n_removed: long>"


def sentences(text: str) -> list[tuple[int, int]]:
    """Start of each sentence and of the next one. White space alone is no sentence: it goes
    with the one before it."""
    spans, start = [], 0
    for gap in BREAK.finditer(text):
        if text[start : gap.start()].strip():
            spans.append((start, gap.end()))
            start = gap.end()
        elif spans:
            spans[-1] = (spans[-1][0], gap.end())
            start = gap.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    elif spans:
        spans[-1] = (spans[-1][0], len(text))
    return spans


def runs(text: str, least: int = SENTENCES, words: int = WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """``(first sentence, sentences, 16 bytes of hash)`` of every run."""
    cut = [text[a:b].split() for a, b in sentences(text)]
    n = len(cut)
    if not n:
        return []
    sizes = np.fromiter(map(len, cut), np.int64, n)
    upto = np.append(0, np.cumsum(sizes))
    place = np.arange(n)
    # Forward: the first end at which both conditions hold; backward: the last start.
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + words), place + least)
    starts = np.minimum(np.searchsorted(upto, upto[1:] - words, side="right") - 1, place + 1 - least)
    found = {(a, b) for a, b in zip(place.tolist(), ends.tolist()) if b <= n}
    found |= {(a, b + 1) for a, b in zip(starts.tolist(), place.tolist()) if a >= 0}
    found |= {(i, i + 1) for i in np.flatnonzero(sizes >= long_words).tolist()}
    digest = xxhash.xxh3_128_digest
    own = b"".join([digest(" ".join(s).encode()) for s in cut])
    return [(a, b - a, digest(own[16 * a : 16 * b])) for a, b in sorted(found)]


def _row():
    return F.xxhash64("doc_id", "text")


def _spread(least: int, words: int, long_words: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [runs(t or "", least, words, long_words) for t in texts]
            counts = [len(f) for f in found]
            keys = np.frombuffer(b"".join([h for f in found for _, _, h in f]), np.dtype([("a", "<i8"), ("b", "<i4"), ("c", "<i4")]))
            docs = np.repeat(np.arange(len(texts)), counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys["a"]), pa.array(keys["b"]),
                batch.column("doc_id").take(pa.array(docs)), batch.column("row").take(pa.array(docs)),
                pa.array([p for f in found for p, _, _ in f], pa.int32()),
                pa.array([s for f in found for _, s, _ in f], pa.int32()),
            ], ["hash", "check", "doc_id", "row", "pos", "size"])

    return spread


def repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id, row, spans`` (array of ``pos, size``): the occurrences that are not the first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("text <> ''").withColumn("row", _row())
    all_runs = texts.mapInArrow(_spread(least, words, long_words), RUNS)
    key = ["hash", "check"]
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("row").alias("r"), F.col("pos").alias("p"))
    # Counted and compared before the shuffle: a run held by very many texts sends one row per task.
    firsts = stored(
        all_runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), "repeated-runs"
    )
    later = _join_spread(all_runs, firsts, key).filter(place != F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "size")).alias("spans"))


def _join_spread(all_runs: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """Every occurrence of the runs in ``firsts``, with their first place. A run with more than two
    partitions' share of all occurrences is cut into pieces by the text it is in; there are
    fewer such runs than partitions, so the list of them is bounded."""
    partitions = rows_in(all_runs.sparkSession)
    total = firsts.agg(F.sum("n")).first()[0] or 1
    hot = firsts.filter(F.col("n") * partitions > 2 * total).select(
        *key, F.ceil(F.col("n") * (CUTS * partitions / total)).cast("int").alias("pieces")
    )
    pieces = F.coalesce("pieces", F.lit(1))
    cut = all_runs.join(F.broadcast(hot), key, "left").withColumn("piece", F.pmod("row", pieces).cast("int"))
    copies = firsts.join(F.broadcast(hot), key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return cut.drop("pieces").join(copies.select(*key, "piece", "first"), [*key, "piece"])


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])
    for texts, spans in batches:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            cut = sentences(text or "")
            gone = {i for s in own or () for i in range(s["pos"], s["pos"] + s["size"])}
            kept = text if not gone else "".join(text[a:b] for i, (a, b) in enumerate(cut) if i not in gone)
            out.append({"text": kept, "n_sentences": len(cut), "n_removed": len(gone)})
        yield pa.array(out, kind)


def remove_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the kept text in ``text`` and a struct ``__kept`` (``text``,
    ``n_sentences``, ``n_removed``)."""
    spans = repeated(docs, least, words, long_words).select(
        F.col("doc_id").alias("__doc"), F.col("row").alias("__of"), F.col("spans").alias("__spans")
    )
    named = docs.withColumn("text", F.col("text").cast("string")).withColumn(
        "__row", F.xxhash64(F.col("doc_id").cast("long"), "text")
    )
    both = named.join(spans, (F.col("__row") == F.col("__of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left")
    cut = F.arrow_udf(_remove, REMOVED)
    return (
        both.withColumn("__kept", cut("text", "__spans")).withColumn("text", F.col("__kept.text"))
        .drop("__row", "__of", "__doc", "__spans")
    )
