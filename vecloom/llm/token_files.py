"""Token ids in binary files of independent zstandard frames with a seek table.

File layout (little-endian throughout):

* one frame a document: its ids as unsigned 32-bit integers, compressed alone;
* a skippable frame (magic 0x184D2A50) with the documents' ids: 8 bytes each;
* a skippable frame (magic 0x184D2A5E), the seek table of the public zstandard
  seekable format: for each frame its compressed size, its decompressed size and
  the low 32 bits of XXH64 of its content, then the number of frames, a
  descriptor byte with the checksum flag (0x80), and the magic 0x8F92EAB1.

Any zstandard decoder reads such a file as a whole; a reader with the table
fetches and decompresses only the frames of the documents asked for.

Writing: documents are ranged by id, so each task writes files of ascending
ids, frame by frame, up to a bound of a file.  A task's attempt writes under a name of its own and lists
the file in its result; a repeated or speculative attempt leaves a file that no
list names.  The listing is one row a file.

Defined results: a null text counts as empty, and an empty document has the end
token alone; repeated ids are separate documents in the order of their texts;
rows without an id are refused; an empty table gives no files; extra columns
are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.scratch import folder, materialize
from vecloom.llm.tokens import encoder, read_declaration

# Fixed values of the zstandard frame and seekable formats.
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<III")
MANIFEST = "path string, first_id long, number long, documents long, tokens long, bytes long"
#: A file is closed at so many bytes or documents, which bounds its index, its seek table and a reader's memory.
FILE_BYTES, FILE_DOCUMENTS = 1 << 30, 1_000_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _uri(path: str) -> str:
    # Hadoop writes file:/x where the URI has an empty host
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class FrameWriter:
    """Appends documents to an open binary stream and closes it with the index and the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level).compress
        self.ids, self.entries, self.tokens, self.size = [], [], 0, 0

    def add(self, doc_id: int, raw: bytes) -> None:
        packed = self.compress(raw)
        self.stream.write(packed)
        self.ids.append(doc_id)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.tokens += len(raw) // 4
        self.size += len(packed)

    def finish(self) -> None:
        index = np.array(self.ids, dtype="<i8").tobytes()
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        for magic, body in ((INDEX_MAGIC, index), (SEEK_MAGIC, table)):
            self.stream.write(struct.pack("<II", magic, len(body)) + body)
            self.size += 8 + len(body)


class FrameReader:
    """Random access to the documents of one file; reads the footer first, then only the frames asked for."""

    def __init__(self, path: str):
        store, name = open_store(_uri(path))
        self.file = store.open_input_file(name)
        size = self.file.size()
        n, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        tail = 8 * n + 8 + 8 + ENTRY.size * n + FOOTER.size
        body = self.file.read_at(tail, size - tail)
        if struct.unpack_from("<II", body) != (INDEX_MAGIC, 8 * n):
            raise ValueError(f"{path} has no document index")
        self.ids = np.frombuffer(body, dtype="<i8", count=n, offset=8)
        table = np.frombuffer(body, dtype="<u4", count=3 * n, offset=8 + 8 * n + 8).reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, i: int) -> bytes:
        raw = self.decompress(self.file.read_at(int(self.packed[i]), int(self.at[i])), max_output_size=int(self.raw[i]))
        return self._checked(i, raw)

    def _checked(self, i: int, raw: bytes) -> bytes:
        if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def documents(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents with this id; ids ascend in a file."""
        a, b = np.searchsorted(self.ids, doc_id, "left"), np.searchsorted(self.ids, doc_id, "right")
        return [np.frombuffer(self.frame(i), dtype="<u4") for i in range(a, b)]

    def all(self, chunk: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """Every document in order, with few large reads."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + chunk, "right")) - 1)
            data = memoryview(self.file.read_at(int(self.at[j] - self.at[i]), int(self.at[i])))
            for k in range(i, j):
                part = data[self.at[k] - self.at[i] : self.at[k + 1] - self.at[i]]
                yield int(self.ids[k]), self._checked(k, self.decompress(part, max_output_size=int(self.raw[k])))
            i = j


def write(docs: DataFrame, tokenizer_path: str, path: str, end: int = 0, files: int | None = None, file_bytes: int = FILE_BYTES, file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """Encode whole texts and write them below ``path`` in ascending doc_id order; returns the listing of files.

    ``files`` tasks write, each as many files as the bounds of a file ask for.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_declaration(tokenizer_path))
    target = _uri(path)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, number = encoder(shipped.value), None, 0

        def closed() -> pa.RecordBatch:
            writer.finish()
            stream.close()
            return pa.RecordBatch.from_pylist([{"path": f"{target}/{name}", "first_id": writer.ids[0], "number": number, "documents": len(writer.ids), "tokens": writer.tokens, "bytes": writer.size}])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_all(batch.column("text"), end)):
                if doc_id is None:
                    raise ValueError("a document without an id can't be written")
                if writer is not None and (writer.size >= file_bytes or len(writer.ids) >= file_documents):
                    yield closed()
                    writer, number = None, number + 1
                if writer is None:
                    store, where = open_store(f"{target}/{uuid.uuid4().hex}.zst")
                    store.create_dir(os.path.dirname(where), recursive=True)
                    stream = store.open_output_stream(where, compression=None, buffer_size=1 << 20)
                    writer, name = FrameWriter(stream), os.path.basename(where)
                writer.add(doc_id, ids.tobytes())
        if writer is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(save, MANIFEST), "token-files")


def starts(manifest: DataFrame) -> DataFrame:
    """The listing with ``base``: tokens in all files before. One row a file, so one task can sum them."""
    before = Window.orderBy("first_id", "number", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the listed files: doc_id, start (tokens before it), and its ids as bytes."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, at in zip(pdf["path"], pdf["base"]):
                rows, size, position = [], 0, int(at)
                for doc_id, raw in FrameReader(path).all():
                    rows.append((doc_id, position, raw))
                    position += len(raw) // 4
                    size += len(raw)
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"])

    listed = starts(manifest)
    return listed.repartition(_tasks(manifest)).mapInPandas(load, "doc_id long, start long, ids binary")


def _tasks(manifest: DataFrame) -> int:
    return max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup(manifest: DataFrame, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents on the driver: opens only the files that can hold them."""
    files = sorted(((r["first_id"], r["path"]) for r in manifest.select("first_id", "path").collect()))
    out: dict[int, np.ndarray] = {}
    for doc_id in doc_ids:
        for i, (first, path) in enumerate(files):
            if first <= doc_id and (i + 1 == len(files) or files[i + 1][0] >= doc_id):
                for ids in FrameReader(path).documents(doc_id):
                    out.setdefault(doc_id, ids)
    return out


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids' bytes."""
    return read_back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def fresh_folder(spark: SparkSession) -> str:
    return folder(spark, "tokens")


