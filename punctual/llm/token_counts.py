"""Token counts of whole texts, huge ones in overlapping chunks that are spliced again.

A text up to ``chunk`` characters is encoded whole. A longer one is cut into chunks, each of
which reads ``overlap`` characters of the next one; the chunks are dealt out over all tasks and
encoded with offsets. Neighbours are spliced at the first boundary that both have in their
overlap and that is proven to be one of the whole text's:

* The first chunk begins where the text does, so its word boundaries are those of the text, up
  to a margin before its end (a word is decided by the few characters after it; an added token,
  such as the mark for the end of a text, by its own length).
* Both kinds of tokenizer cut a text into words from left to right, and what follows a boundary
  depends on nothing before it. So from a boundary that it shares with its left neighbour, a
  chunk has the boundaries, and the tokens, of the text.
* sentencepiece merges over word borders, but never in a piece that holds a space after another
  character, if its vocabulary has no such piece: a space after another character is a boundary.

A text with a pair of chunks that share no boundary is cut anew with an overlap, and if need be
chunks, several times as wide, until all pairs do or one chunk holds the text.

Nulls and edges: a null or empty text has no bytes and no tokens. Rows with the same ``doc_id``
(or none) are counted each. A table without rows gives none. Other columns are not read.
Special strings inside a text count as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from punctual.llm.common import rows_in, slices, stored, text_column
from punctual.llm.tokens import Tokens

#: Characters of a chunk, and how many of the next one it reads at first.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: No boundary is trusted this close to the end of a chunk, beside the longest added token.
MARGIN = 16
#: Overlaps grow by this factor.
WIDER = 8
LIMIT = 1024
#: Text encoded at once.
SLICE_BYTES = 3 << 20
#: How a byte-level vocabulary cuts texts.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

CHUNKS = "key long, doc_id long, n_bytes long, number int, last boolean, start long, core int, text string"
ENCODED = ("key long, doc_id long, n_bytes long, number int, last boolean, n_tokens long, "
           "head array<long>, head_before array<long>, tail array<long>, tail_before array<long>")


class Library:
    """A vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t["content"] for t in kind.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.margin = MARGIN + max(map(len, added), default=0)
        self.normalised = kind.get("normalizer") is not None
        plain = not self.normalised and BYTE_LEVEL.items() <= (kind.get("pre_tokenizer") or {}).items()
        # Such a token takes any number of characters around it.
        self.local = not any(t.get("lstrip") or t.get("rstrip") for t in kind.get("added_tokens") or [])
        # Words that come again and again are merged once.
        self.words = Tokens(path) if plain else None

    def _direct(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        if self.words is None:
            return np.array(self._direct([t or "" for t in texts.to_pylist()]), np.int64)
        out = np.zeros(len(texts), np.int64)
        marked = pc.match_substring_regex(texts, self.special.pattern) if self.special.pattern != "(?!)" else None
        own = np.zeros(len(texts), bool) if marked is None else pc.fill_null(marked, False).to_numpy(zero_copy_only=False)
        out[~own] = self.words.count(texts.filter(pa.array(~own)))
        out[own] = self._direct(texts.filter(pa.array(own)).to_pylist())
        return out

    def bounds(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of tokens, the characters at which words begin, and the tokens before each."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        before = np.flatnonzero(np.diff(words, prepend=-2) != 0) if self.local else np.zeros(0, np.int64)
        starts = np.array([a for a, _ in found.offsets], np.int64).reshape(-1)[before]
        if self.normalised:
            # No character is composed with an ASCII one before which a text is cut.
            plain = np.array([text[a : a + 1].isascii() for a in starts.tolist()], bool)
            before, starts = before[plain], starts[plain]
        return len(words), starts, before


class Pieces:
    """A sentencepiece model."""

    margin = MARGIN

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  a  b \n c\tﬁ "
        marked = probe.replace(" ", "▁")
        # Otherwise no boundary is proven: such a model encodes whole texts only.
        self.local = not any(re.search("[^▁]▁", n) for n in names) and self.model.normalize(
            probe
        ) in (marked, "▁" + marked)

    def counts(self, texts: pa.Array) -> np.ndarray:
        found = self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)
        return np.array([len(ids) for ids in found], np.int64)

    def bounds(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        pieces = self.model.encode(text, return_type="proto").pieces
        if not self.local:
            return len(pieces), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Offsets count bytes: a byte that goes on with a character begins none.
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = character[np.minimum([p.begin for p in pieces], len(data) - 1)] if len(data) else np.zeros(0, np.int64)
        proven = [a > 0 and text[a] == " " and text[a - 1] not in " ▁" for a in starts.tolist()]
        before = np.flatnonzero(proven)
        return len(pieces), starts[before].astype(np.int64), before


_loaded: dict[str, Library | Pieces] = {}


def library(path: str) -> Library | Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path) if path.endswith(".model") else Library(path)
    return _loaded[path]


def _whole(docs: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            found = pa.array(library(path).counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), found], ["doc_id", "n_bytes", "n_tokens"]
            )

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk: ``core`` characters from ``start`` on, and the overlap behind them."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("number", pa.int32()),
            ("last", pa.bool_()), ("start", pa.int64()), ("core", pa.int32()), ("text", pa.string()),
        ])
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            for key, doc, size, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "n_bytes", "text"))):
                rows = []
                # The last chunk takes the rest, so that none is shorter than an overlap.
                for number in range(pieces := max(1, len(text) // chunk)):
                    start, last = number * chunk, number == pieces - 1
                    stop = len(text) if last else start + chunk
                    rows.append((key, doc, size, number, last, start, stop - start, text[start : stop + overlap]))
                    if last or len(rows) * chunk >= SLICE_BYTES:
                        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                        yield pa.RecordBatch.from_arrays(columns, names)
                        rows = []

    return docs.mapInArrow(cut, CHUNKS)


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """The tokens of each chunk, and the boundaries in its overlaps with both neighbours."""
    names = [c.split()[0] for c in ENCODED.split(", ")]
    kept = ["key", "doc_id", "n_bytes", "number", "last"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library(path)
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            totals, found = [], [[], [], [], []]
            for start, core, text in zip(*(batch.column(c).to_pylist() for c in ("start", "core", "text"))):
                total, at, before = coder.bounds(text)
                totals.append(total)
                for side, (a, b) in enumerate(((0, overlap), (core, core + overlap))):
                    own = (at >= a + coder.margin) & (at <= b - coder.margin)
                    found[2 * side].append((at[own] + start).tolist())
                    found[2 * side + 1].append(before[own].tolist())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(totals, pa.int64()), *lists], names
            )

    return chunks.mapInArrow(encode, ENCODED)


def _spliced(encoded: DataFrame) -> DataFrame:
    """``key, doc_id, n_bytes, n_tokens`` per text; ``n_tokens`` is null where two neighbours
    share no boundary. A text's chunks are few numbers each."""
    order = Window.partitionBy("key").orderBy("number")
    shared = F.get(F.array_intersect("tail", "next_head"), 0)
    before = lambda at, counts: F.element_at(counts, F.array_position(at, F.col("seam")).cast("int"))
    seams = (
        encoded.withColumns({"next_head": F.lead("head").over(order), "next_before": F.lead("head_before").over(order)})
        .withColumn("seam", shared)
        .withColumn("own", F.when(F.col("last"), F.col("n_tokens")).when(
            F.col("seam").isNotNull(), before("tail", "tail_before") - before("next_head", "next_before")))
    )
    return seams.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"),
    )


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, overlap`` per document: ``overlap`` is the one
    at which all its chunks could be spliced, 0 for a text encoded whole."""
    spark = docs.sparkSession
    rows = text_column(docs, id_column, text).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    huge = F.coalesce(F.length("text") > chunk, F.lit(False))
    done = [_whole(rows.filter(~huge), vocabulary).withColumn("overlap", F.lit(0))]
    left = stored(rows.filter(huge).withColumn("key", F.monotonically_increasing_id()), "huge-texts")
    while not left.isEmpty():
        chunks = _cut(left, chunk, overlap).repartition(rows_in(spark), "key", "number")
        found = stored(_spliced(_encoded(chunks, vocabulary, overlap)), "spliced")
        done.append(found.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", F.lit(overlap).alias("overlap")))
        left = left.join(found.filter("n_tokens is null").select("key"), "key", "left_semi").select(*left.columns)
        overlap *= WIDER
        chunk = max(chunk, WIDER * overlap)
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "overlap"
    )
