"""Token-id files with Elias-Fano coded document boundaries.

``write_files`` puts the ids of all documents, in ascending order of ``doc_id``, into binary
files of bounded size; ``read_documents`` gives them back per document. A file holds, after
an 8-byte mark and a JSON header with its length in 4 bytes:

* the ids, back to back, 2 bytes each where the vocabulary fits, else 4 (little-endian);
  an id that does not fit raises an error;
* the Elias-Fano code of the positions at which documents end, and one of the ``doc_id``;
* which documents had no ``doc_id`` (they come first, as Spark sorts nulls).

Elias-Fano splits each of n ascending numbers below u into ``log2(u / n)`` low bits, kept as
they are, and the rest, kept as gaps in unary: about ``2 + log2(u / n)`` bits a number. The
place of every 512th one-bit is kept, so that ``select`` looks at a short run of bits.

Nulls and edges: a null or empty text is a document of the end id alone; repeated ``doc_id``
are separate documents next to each other; a table without rows gives no file and no rows;
other columns are not read. Long texts are encoded whole.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from punctual.llm.common import rows_in, scratch_path, slices, stored, text_column
from punctual.llm.tokens import tokens

MARK = b"EFTOKEN1"
SAMPLE = 512
#: Ids per file: bounds what a task holds when it writes or reads one.
FILE_IDS = 2_000_000
#: Text encoded at once: about thirty bytes of index for each of its words.
SLICE_BYTES = 3 << 20
MANIFEST = "file string, part int, seq int, documents long, ids long"


class EliasFano:
    """Ascending numbers from 0 on in near-minimal space, each found without the others."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, low_bits), np.uint8)
        for bit in range(low_bits):
            low[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little")
        return cls(n, low_bits, pack(low.reshape(-1)), pack(high), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.uint64)
        for bit in range(self.low_bits):
            at = i * self.low_bits + bit
            value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(bit)
        return value

    def select(self, i: int) -> int:
        """The i-th number (from 0): a sampled place, then the one-bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first = place >> 3, place & 7
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")[first:]
            found = np.flatnonzero(bits)
            if left < len(found):
                one = byte * 8 + first + int(found[left])
                return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])
            left -= len(found)
            byte, first = byte + 64, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(np.arange(self.n))

    def blocks(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]

    @classmethod
    def read(cls, n: int, low_bits: int, blocks: list[bytes]) -> EliasFano:
        return cls(n, low_bits, *(np.frombuffer(b, t) for b, t in zip(blocks, ("u1", "u1", "<u4"))))


def pack_file(ids: np.ndarray | list[np.ndarray], lengths: np.ndarray, keys: list[int | None],
              width: int) -> list[bytes | memoryview]:
    """The parts of one file, to be written one after the other; ``keys`` are the documents'
    ids, ascending, nulls first."""
    runs = [ids] if isinstance(ids, np.ndarray) else ids
    if any(len(run) and int(run.max()) >> (8 * width) for run in runs):
        raise ValueError(f"an id does not fit into {width} bytes")
    missing = sum(k is None for k in keys)
    base = keys[missing] if missing < len(keys) else 0
    ends = EliasFano.of(np.cumsum(lengths))
    own = EliasFano.of(np.array([k - base for k in keys[missing:]], np.uint64))
    blocks = [*ends.blocks(), *own.blocks()]
    flat = [memoryview(run.astype(f"<u{width}", copy=False)).cast("B") for run in runs if len(run)]
    header = json.dumps({
        "width": width, "documents": len(keys), "without_id": missing, "base": base,
        "low_bits": [ends.low_bits, own.low_bits], "blocks": [sum(map(len, flat)), *map(len, blocks)],
    }).encode()
    return [MARK, len(header).to_bytes(4, "little"), header, *flat, *blocks]


class TokenFile:
    """A file's documents, each reached by its place without decoding the others."""

    def __init__(self, data: bytes | memoryview):
        if data[:8] != MARK:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:12], "little")
        header = json.loads(bytes(data[12 : 12 + size]))
        view, at, blocks = memoryview(data), 12 + size, []
        for n in header["blocks"]:
            blocks.append(view[at : at + n])
            at += n
        self.documents, self.missing, self.base = header["documents"], header["without_id"], header["base"]
        self.ids = np.frombuffer(blocks[0], f"<u{header['width']}")
        self.ends = EliasFano.read(self.documents, header["low_bits"][0], blocks[1:4])
        self.keys = EliasFano.read(self.documents - self.missing, header["low_bits"][1], blocks[4:7])

    def document(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return self.ids[start : self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.missing else self.base + self.keys.select(i - self.missing)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.missing + [self.base + int(k) for k in self.keys.all()]


def _put(folder: str, name: str, parts: list[bytes | memoryview]) -> None:
    """Under another name first: a task that is run again, or twice at once, leaves the same
    whole file."""
    store, root = fs.FileSystem.from_uri(folder)
    part = posixpath.join(root, f"_{uuid.uuid4().hex}")
    with store.open_output_stream(part) as out:
        for data in parts:
            out.write(data)
    store.move(part, posixpath.join(root, name))


def write_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, width: int | None = None,
                file_ids: int = FILE_IDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids below ``folder`` (shared by all executors) and return the
    stored manifest: one row per file in order, with its number of documents and ids.

    The rows are dealt out by ranges of ``doc_id`` (and the text's hash, so that one id with
    very many rows is spread too), sorted, encoded and written as they come by. Without a
    ``width`` an id takes 2 bytes if all ids of the vocabulary fit, else 4.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = (
        text_column(docs, id_column, text)
        .repartitionByRange(rows_in(spark), *order)
        .sortWithinPartitions(*order)
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = tokens(tokenizer), TaskContext.get().partitionId(), 0
        size = width or (2 if max(coder.largest, end) < 1 << 16 else 4)
        ids, lengths, keys, held = [], [], [], 0

        def flush():
            nonlocal ids, lengths, keys, held, seq
            name = f"tokens-{part:06d}-{seq:06d}.bin"
            _put(folder, name, pack_file(ids, np.concatenate(lengths), keys, size))
            row = [[name], [part], [seq], [len(keys)], [held]]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = ["file", "part", "seq", "documents", "ids"]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)
            ids, lengths, keys, held, seq = [], [], [], 0, seq + 1
            return out

        for batch in slices(batches, most_bytes=SLICE_BYTES):
            own, sizes = coder.encode(batch.column("text"), end)
            if not own.max() >> (8 * size):
                own = own.astype(f"<u{size}")
            ids.append(own)
            lengths.append(sizes)
            keys += batch.column("doc_id").to_pylist()
            held += len(own)
            if held >= file_ids:
                yield flush()
        if keys:
            yield flush()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32, file,
    place``. ``start`` counts the ids of all documents before it."""
    spark = manifest.sparkSession
    # Totals per part first: the window over parts has one row for each.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("file", (F.col("before") + F.col("own")).alias("file_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("content")):
                one = TokenFile(memoryview(data.as_buffer()))
                ends = one.ends.all().astype(np.int64)
                begins = np.append(0, ends[:-1])
                sums = [
                    zlib.crc32(one.ids[a:b].astype("<u4")) for a, b in zip(begins.tolist(), ends.tolist())
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.doc_ids(), pa.int64()), pa.array(begins), pa.array(ends - begins),
                    pa.array(sums, pa.int64()), pa.array([name.as_py()] * len(sums), pa.string()),
                    pa.array(range(len(sums)), pa.int64()),
                ], ["doc_id", "local", "n_tokens", "ids_crc32", "file", "place"])

    if manifest.isEmpty():
        return spark.createDataFrame(
            [], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, place long"
        )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content"
    )
    found = files.mapInArrow(
        read, "doc_id long, local long, n_tokens long, ids_crc32 long, file string, place long"
    )
    return found.join(starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "place"
    )


def encode_to_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files into a fresh folder of the shared one and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_documents(write_files(docs, folder, tokenizer, **options), folder)
