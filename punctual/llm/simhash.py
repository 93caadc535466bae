"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it.
Two fingerprints link at ``most_bits`` differing bits or fewer.

The 64 bits are cut into parts; bits that tend to agree, as a sample of fingerprints shows,
share a part, so that the parts differ in what they tell. If the parts get thresholds that sum
to ``most_bits - parts + 1`` (a part may get -1: not probed), then two linked fingerprints
differ in some part by no more than its threshold. The thresholds come from dynamic programming
over the number of candidates that the sample lets expect. Each fingerprint is listed under its
value of every part and probes the values within the part's threshold; candidates are verified
on all bits.

A value that more than ``BUCKET`` fingerprints share is not paired out. Its fingerprints are
linked exactly in another way: two of them differ in at most two bits if and only if some
number is at most one bit away from both, so each is listed under its 65 such numbers, and
those that meet under one (65 at most) are linked to its smallest.

Nulls and edges: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other; fewer words than a shingle are hashed as one sequence. Rows with the same
``doc_id`` count as one document. A row without ``doc_id`` has a fingerprint but no component
and links nothing. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import slices, stored, text_column
from punctual.llm.components import components

SHINGLE = 3
MOST_BITS = 2
PARTS = 3
SEED = 42
#: Fingerprints that the parts and thresholds are planned on, those of smallest hash.
SAMPLE = 5_000
BUCKET = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())
    view = memoryview(joined)
    hashes = np.array([digest(view[a:b], SEED) for a, b in spans], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int32) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, bits``: the fingerprint as a signed long."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    make = F.arrow_udf(read, "long")
    return text_column(docs).select("doc_id", make(F.col("text").cast("string")).alias("bits"))


def plan(sample: np.ndarray, total: int, parts: int = PARTS, most_bits: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """Each part's bits and threshold. ``sample``: fingerprints as unsigned 64-bit numbers."""
    sample = np.asarray(sample, np.uint64)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(sample) > 1:
        spread = bits - bits.mean(0)
        scale = np.sqrt((spread**2).sum(0))
        alike = np.abs(spread.T @ spread / np.maximum(np.outer(scale, scale), 1e-9))
    else:
        alike = np.zeros((64, 64))
    sizes = [64 // parts + (i < 64 % parts) for i in range(parts)]
    left, groups = set(range(64)), []
    for size in sizes:
        # Start with the bit that is most alike to others left, then add its likes.
        rest = sorted(left)
        group = [max(rest, key=lambda b: alike[b, [x for x in rest if x != b]].sum())]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: alike[b, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    scale = (total / max(len(sample), 1)) ** 2

    def expected(group: list[int], threshold: int) -> float:
        """Candidate pairs and probes if the part gets this threshold."""
        if threshold < 0:
            return 0.0
        own = bits[:, group].astype(np.uint64)
        values = (own << np.arange(len(group), dtype=np.uint64)).sum(1, dtype=np.uint64)
        found, counts = np.unique(values, return_counts=True)
        pairs, probes = float((counts * (counts - 1.0)).sum()) / 2, 1.0
        if threshold >= 1:
            for bit in range(len(group)):
                near = np.searchsorted(found, found ^ np.uint64(1 << bit)).clip(max=len(found) - 1)
                same = found[near] == found ^ np.uint64(1 << bit)
                pairs += float((counts * counts[near])[same].sum()) / 2
            probes += len(group)
        if threshold >= 2:
            probes += len(group) * (len(group) - 1) / 2
            pairs *= len(group) / 2
        return pairs * scale + probes * total

    # Smallest cost of the first parts by the sum of their thresholds.
    goal = most_bits - parts + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        after: dict[int, tuple[float, list[int]]] = {}
        costs = {t: expected(group, t) for t in range(-1, most_bits + 1)}
        for used, (cost, chosen) in best.items():
            for t, more in costs.items():
                if used + t not in after or cost + more < after[used + t][0]:
                    after[used + t] = (cost + more, [*chosen, t])
        best = after
    return [(g, t) for g, t in zip(groups, best[goal][1])]


def _part(bits, group: list[int]):
    """The bits of a group, where they stand; a number of its own for every value."""
    mask = sum(1 << b for b in group)
    return bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(group: list[int], times: int) -> list[int]:
    masks = [0]
    if times >= 1:
        masks += [1 << b for b in group]
    if times >= 2:
        masks += [1 << a | 1 << b for a in group for b in group if a < b]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, most_bits: int = MOST_BITS, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``a, b`` of different ``bits`` values whose links join all that are linked.
    ``prints`` has each value once."""
    if most_bits != 2:
        raise ValueError("values that very many share are linked exactly for two bits only")
    own = prints.select("bits")
    sample = [r[0] & (1 << 64) - 1 for r in own.orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).collect()]
    chosen = plan(np.array(sample, np.uint64), max(own.count(), 1), parts, most_bits)
    listed = own.select("bits", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), _part(F.col("bits"), group).alias("value"))
        for i, (group, t) in enumerate(chosen) if t >= 0
    ])).alias("at")).select("bits", "at.*")
    probes = listed
    if any(t > 0 for _, t in chosen):
        wide = [F.when(F.col("part") == i, F.array(*[F.lit(m) for m in _flips(group, t)])) for i, (group, t) in enumerate(chosen) if t >= 0]
        probes = listed.withColumn("flip", F.explode(F.coalesce(*wide))).select(
            "bits", "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value")
        )
    sizes = listed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size"))
    if probes is listed:
        sizes = sizes.filter("size > 1")
    met = stored(probes.join(sizes, ["part", "value"]), "probes")
    few = met.filter(F.col("size") <= bucket)
    right = few if probes is listed else stored(listed.join(sizes.filter(F.col("size") <= bucket), ["part", "value"]), "listed")
    pairs = few.select("part", "value", F.col("bits").alias("a")).join(
        right.select("part", "value", F.col("bits").alias("b")), ["part", "value"]
    ).filter("a < b" if probes is listed else "a <> b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits).select("a", "b")
    many = met.filter(F.col("size") > bucket).select("bits")
    if probes is not listed:
        many = many.unionByName(listed.join(sizes.filter(F.col("size") > bucket), ["part", "value"]).select("bits"))
    near = many.distinct().select(
        "bits", F.explode(F.transform(F.array(*[F.lit(m) for m in _flips(list(range(64)), 1)]), lambda m: F.col("bits").bitwiseXOR(m))).alias("near")
    )
    # At most 65 values are one bit away from a number or equal to it.
    stars = near.groupBy("near").agg(F.collect_list("bits").alias("all")).filter(F.size("all") > 1).select(
        F.array_min("all").alias("a"), F.explode("all").alias("b")
    ).filter("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, parts: int = PARTS) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``component_id``, the smallest ``doc_id`` reachable."""
    made = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(made.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("first")), "prints")
    found = links(prints, most_bits, parts)
    first = lambda side: prints.select(F.col("bits").alias(side), F.col("first").alias(f"first_{side}"))
    edges = found.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    # A document with two texts joins what either is linked to.
    several = made.groupBy("doc_id").agg(F.count_distinct("bits").alias("texts")).filter("texts > 1")
    both = made.join(several, "doc_id").join(prints, "bits").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    joined = components(edges.unionByName(both))
    by_bits = prints.join(joined.withColumnRenamed("id", "first"), "first", "left").select(
        "bits", F.coalesce("component", "first").alias("component")
    )
    return made.join(by_bits, "bits", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
