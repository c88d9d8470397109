"""SentencePiece encoding and decoding as a relational lattice.

A text is normalized as the model asks (a dummy space in front, spaces as the
meta symbol) and cut into words wherever no piece of the table holds the two
characters beside the cut.  No piece spans such a place, so every path through
a text passes it, and words can be encoded apart from each other.

* Every distinct word is exploded into its substrings of bounded length;
* an equi-join with the piece table keeps those that are pieces (the edges);
* edges are grouped by word, and a Spark higher-order ``aggregate`` folds them
  left to right into the best-scoring path (Viterbi, ties to the earliest
  start, as the unigram algorithm of the library has it).  The fold holds the
  scores of the last ``longest`` positions only;
* a character without a piece is an edge of score (least score - 10) that turns
  into the byte pieces of its UTF-8 bytes.

Texts do not travel.  They are cut once, in Arrow batches, into parts of at
most ``PART_CHARS`` characters (a longer text is a part of its own) that hold
their distinct words and, for each text, the numbers of its words; parts are
written as a table bucketed by part.  Only distinct words cross an exchange: to
their ids, and back to their parts.  A word has one row a part however often
it occurs, so no word is hot.

The path is the best one under the scores of the piece table, the one that the
library's n-best search finds for the same table as a unigram model.  A model
file made for merges (BPE) is used as such a table too; its merge order would
give other ids for some words.

Defined results.  Encoding: a null or empty text has no ids; bytes that are not
UTF-8 count as U+FFFD; rows that share a doc_id each keep their own ids; extra
columns are ignored; an empty table gives no rows.  A word that cannot be cut is
one row of about 80 bytes a character.  Decoding concatenates pieces and bytes
and gives back the text, but for the meta symbol itself (U+2581), which comes
back as a space, as it does in the library; null ids give a null text, no ids
the empty text; an id that is no piece, and bytes that are not UTF-8, come back
as U+FFFD.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.native_text import bind
from vecloom.llm.scratch import folder

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of a part, and of what is cut at once.
PART_CHARS, SLICE_CHARS = 32 << 20, 1 << 19
#: Longer words are named by a digest where rows are keyed by word.
KEY_CHARS = 64
#: Characters of a long word that are exploded from one substring of it, and values that are folded at a time.
CHUNK, BLOCK = 1024, 128
PARTS = "part long, words array<string>, docs array<long>, sizes array<int>, codes binary"
#: A word's place as one number: bits of its number in the part, and of the part's in the task.
CODE_BITS, TASK_PARTS_BITS = 27, 12
#: Words whose ids are laid out at once.
JOINED_WORDS = 1 << 19
#: An edge as one number, ordered by end, then start: the end, 255 less the length, and what it stands for.
VALUE_BITS, LENGTH_BITS = 22, 8


@dataclass(frozen=True)
class PieceTable:
    pieces: tuple[tuple[int, str, float], ...]
    #: Id of the byte piece of each byte.
    bytes: tuple[int, ...]
    longest: int
    unknown: float


def load_pieces(path: str) -> PieceTable:
    """Normal and byte pieces of a model file; refuses models whose words couldn't be encoded apart."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with identity normalization and a dummy prefix are supported")
    normal = [(i, p.piece, float(p.score)) for i, p in enumerate(model.pieces) if p.type == 1]
    raw = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    if len(raw) != 256 or any(META in p.lstrip(META) for _, p, _ in normal):
        raise ValueError("the model has no byte fallback, or pieces that span words")
    longest = max(len(p) for _, p, _ in normal)
    if longest >= 1 << LENGTH_BITS or len(model.pieces) >= 1 << (VALUE_BITS - 1):
        raise ValueError("the model has too many or too long pieces")
    return PieceTable(tuple(normal), tuple(raw[b] for b in range(256)), longest, min(s for *_, s in normal) - UNKNOWN_PENALTY)


# ------------------------------------------------------------ cutting texts
class Cutter:
    """Cuts normalized texts wherever no piece holds both neighbours; many texts at once."""

    def __init__(self, pieces: list[str]):
        held = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        letters = sorted({c for pair in held for c in pair})
        number = {c: i for i, c in enumerate(letters, 1)}
        self.width = len(letters) + 1
        #: Number of each character; 0 for those that no piece has beside another.
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.joined = np.zeros(self.width * self.width, dtype=bool)
        self.joined[[number[a] * self.width + number[b] for a, b in held]] = True

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after the other, and how many each text has."""
        whole = "".join(texts)
        until = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        code = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        number = self.number[code]
        first = np.ones(len(code), dtype=bool)
        if len(code):
            first[1:] = ~self.joined[number[:-1] * self.width + number[1:]]
            first[until[:-1][until[:-1] < len(code)]] = True  # a text begins, maybe after empty ones
        begin = np.flatnonzero(first)
        data, at = whole.encode(), begin
        if len(data) != len(code):
            before = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64)
            at = np.where(begin > 0, before[begin - 1], 0)
        offsets = np.append(at, len(data))
        kind, wide = (pa.string(), "<i4") if len(data) < 1 << 31 else (pa.large_string(), "<i8")
        cut = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets.astype(wide).tobytes()), pa.py_buffer(data)])
        return cut, np.diff(np.searchsorted(begin, until), prepend=0)


def normalized(text: bytes | None) -> str:
    """Null and empty texts have nothing to encode, not even the dummy space."""
    return META + text.decode("utf-8", "replace").replace(" ", META) if text else ""


class Part:
    """Texts being gathered: distinct words so far, and the texts' words by number."""

    def __init__(self):
        self.docs, self.sizes, self.numbers, self.chars = [], [], [], 0
        self.words = pa.array([], pa.large_string())

    def add(self, words: pa.Array, sizes: np.ndarray) -> None:
        found = words.cast(pa.large_string()).dictionary_encode()
        place = pc.index_in(found.dictionary, value_set=self.words)
        fresh = place.is_null()
        number = place.fill_null(0).to_numpy(zero_copy_only=False).astype("<u4")
        unseen = fresh.to_numpy(zero_copy_only=False)
        number[unseen] = np.arange(len(self.words), len(self.words) + unseen.sum())
        self.words = pa.concat_arrays([self.words, found.dictionary.filter(fresh)])
        self.numbers.append(number[found.indices.to_numpy()])
        self.sizes.append(sizes)

    def row(self, part: int) -> pa.RecordBatch:
        """The part as a row; its words are numbered by falling frequency, and numbers written as byte planes."""
        n = sum(map(len, self.numbers))
        seen = np.zeros(len(self.words), dtype=np.int64)
        for numbers in self.numbers:
            seen += np.bincount(numbers, minlength=len(seen))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), dtype="<u4")
        rank[order] = np.arange(len(order))
        planes, at = np.empty((1 + sum(len(order) > 1 << b for b in (8, 16, 24)), n), dtype=np.uint8), 0
        for numbers in self.numbers:
            own = rank[numbers]
            for i, plane in enumerate(planes):
                plane[at : at + len(own)] = own >> (8 * i) & 255
            at += len(own)
        words, packed = self.words.take(pa.array(order)).cast(pa.string()), zstandard.ZstdCompressor(level=3).compress(planes)
        columns = [pa.array([part]), _listed(words), _listed(pa.array(self.docs, pa.int64())), _listed(pa.array(np.concatenate(self.sizes), pa.int32())), pa.array([packed])]
        return pa.record_batch(columns, names=[c.split()[0] for c in PARTS.split(", ")])


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _numbers(planes: np.ndarray) -> np.ndarray:
    """Word numbers from their bytes, the lowest first."""
    out = np.zeros(planes.shape[1], dtype=np.int64)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * i)
    return out


def parts(docs: DataFrame, table: PieceTable, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(part, words, docs, sizes, codes): the texts as numbers of their part's distinct words."""
    pieces = docs.sparkSession.sparkContext.broadcast([p for _, p, _ in table.pieces])  # the vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task, number, part = Cutter(pieces.value), TaskContext.get().partitionId(), 0, Part()
        texts, size = [], 0
        for batch in batches:
            own, raw = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                part.docs.append(own[i].as_py())
                texts.append(normalized(raw[i].as_py()))
                size += len(texts[-1])
                part.chars += len(texts[-1])
                if size >= SLICE_CHARS or part.chars >= part_chars:
                    part.add(*cutter.words(texts))
                    texts, size = [], 0
                if part.chars >= part_chars:
                    yield part.row(_place(task, number))
                    number, part = number + 1, Part()
            del batch, own, raw  # before the next one is there
        if texts:
            part.add(*cutter.words(texts))
        if part.docs:
            yield part.row(_place(task, number))
        del part
        _give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # texts that are read by one task share their dictionary, so no more tasks than shuffles have
    return rows.coalesce(_partitions(docs.sparkSession)).mapInArrow(cut, PARTS)


def _give_back() -> None:
    """Returns freed memory to the system: the worker stays for other tasks, and the JVM beside it may need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def _place(task: int, number: int) -> int:
    if number >= 1 << TASK_PARTS_BITS or task >= 1 << (63 - TASK_PARTS_BITS - CODE_BITS):
        raise ValueError("too many parts: read the texts with more, or fewer, tasks")
    return task << TASK_PARTS_BITS | number


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` written to the shared folder, dealt by ``key``: grouping by it later moves nothing."""
    spark = rows.sparkSession
    name = f"vecloom_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(_partitions(spark), key).option("compression", "zstd").option("path", folder(spark, "parts")).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the name only: the files are the caller's


# -------------------------------------------------------------- the lattice
def key_of(word: Column) -> Column:
    """The word itself, or its digest if it is long: what its edges are grouped by."""
    key = F.when(F.length(word) <= KEY_CHARS, word).otherwise(F.concat(F.lit("\x01"), F.sha2(word.cast("binary"), 256)))
    return F.coalesce(key, F.lit(""))  # words are never null; now Spark knows


def edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """(the columns of ``words``, edge, score, end, size) for every piece in every ``word``.

    A character that is no piece is an edge of its code point, so a path always
    exists.  Substrings are taken from one of bounded length, since finding a
    place in a string takes as long as the place is far.  The join is on a hash
    of the piece, a number, and then on the piece itself.
    """
    spark = words.sparkSession
    own = [c for c in words.columns if c != "word"]
    rows = [(p, 2 * i, s) for i, p, s in table.pieces]
    pieces = spark.createDataFrame(rows, "known string, value long, score double").withColumn("hash", F.xxhash64("known"))
    chunks = words.select(*own, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(CHUNK))).alias("ahead"))
    chunks = chunks.select(*own, "ahead", F.expr(f"substring(word, ahead + 1, {CHUNK + table.longest - 1})").alias("chunk"))
    starts = chunks.select(*own, "ahead", "chunk", F.explode(F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(CHUNK)))).alias("at"))
    starts = starts.select(*own, (F.col("ahead") + F.col("at") - 1).alias("start"), F.expr(f"substring(chunk, at, {table.longest})").alias("rest"))
    tried = starts.select(*own, "start", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("size"))
    tried = tried.select(*own, "start", "size", F.expr("substring(rest, 1, size)").alias("piece"))
    found = tried.withColumn("hash", F.xxhash64("piece")).join(F.broadcast(pieces), "hash", "left")  # the table's size is the vocabulary's
    held = F.coalesce(F.col("known") == F.col("piece"), F.lit(False))
    found = found.where(held | (F.col("size") == 1))
    value = F.when(held, F.col("value")).otherwise(2 * F.ascii("piece").cast("long") + 1)
    end = F.col("start") + F.col("size")
    order = end.cast("long") * (1 << LENGTH_BITS + VALUE_BITS) + ((1 << LENGTH_BITS) - 1 - F.col("size")).cast("long") * (1 << VALUE_BITS)
    return found.select(*own, (order + value).alias("edge"), F.when(held, F.col("score")).otherwise(F.lit(table.unknown)).alias("score"), end.alias("end"), "size")


def _length(edge: Column) -> Column:
    return (F.lit((1 << LENGTH_BITS) - 1) - F.shiftright(edge, VALUE_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))).cast("int")


def _folded(values: Column, start: dict[str, Column], step: Callable[[Column, Column], Column], settle: Callable[[Column], dict[str, Column]], finish: Callable[[Column], Column]) -> Column:
    """A fold whose state lists longs (``open``) beside the fields of ``start``; ``finish`` gets them all (``listed``).

    A fold copies its state at every step, so ``BLOCK`` values are folded at a
    time; then what they list is set aside and ``settle`` gives the fields to go
    on with.  Long words take little more than linear time.
    """

    def over(values: Column) -> Column:
        def block(acc: Column, at: Column) -> Column:
            fresh = F.struct(F.array().cast("array<bigint>").alias("open"), *[acc[f].alias(f) for f in start])
            return F.aggregate(F.slice(values, at, F.lit(BLOCK)), fresh, step, lambda s: F.struct(F.array_append(acc["blocks"], s["open"]).alias("blocks"), *[c.alias(f) for f, c in settle(s).items()]))

        first = F.struct(F.array().cast("array<array<bigint>>").alias("blocks"), *[c.alias(f) for f, c in start.items()])
        done = lambda acc: finish(F.struct(F.flatten(acc["blocks"]).alias("listed"), *[acc[f].alias(f) for f in start]))
        return F.aggregate(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), first, block, done)

    return bind(values, over)


def best_edges(found: Column, longest: int) -> Column:
    """The best edge into each position from 1 on, from edges (edge, score, end, size) ordered by edge; one edge of 0 comes first."""

    def step(acc: Column, e: Column) -> Column:
        # edges come by end and start, so the longest edge into a position comes first: it closes the position before
        before = F.when(e["size"] == 1, acc["score"]).otherwise(F.element_at(acc["scores"], 1 - e["size"]))
        closed = F.struct(
            F.array_append(acc["open"], acc["edge"]).alias("open"),
            F.array_append(acc["scores"], acc["score"]).alias("scores"),
            e["end"].alias("end"),
            (before + e["score"]).alias("score"),
            e["edge"].alias("edge"),
        )
        total = F.element_at(acc["scores"], -e["size"]) + e["score"]
        moved = F.struct(acc["open"].alias("open"), acc["scores"].alias("scores"), acc["end"].alias("end"), total.alias("score"), e["edge"].alias("edge"))
        return F.when(e["end"] > acc["end"], closed).when(total > acc["score"], moved).otherwise(acc)

    # scores are those of the positions before ``end``, the nearest last
    start = {"scores": F.array().cast("array<double>"), "end": F.lit(0), "score": F.lit(0.0), "edge": F.lit(0).cast("long")}
    recent = lambda s: F.when(F.size(s["scores"]) > longest, F.slice(s["scores"], -longest, longest)).otherwise(s["scores"])
    return _folded(found, start, step, lambda s: {f: s[f] for f in start} | {"scores": recent(s)}, lambda acc: F.array_append(acc["listed"], acc["edge"]))


def traced(best: Column) -> Column:
    """Values of the path's edges from the last to the first."""

    def step(acc: Column, edge: Column) -> Column:
        taken = F.struct(F.array_append(acc["open"], edge.bitwiseAND(F.lit((1 << VALUE_BITS) - 1))).alias("open"), (_length(edge) - 1).alias("skip"))
        passed = F.struct(acc["open"].alias("open"), (acc["skip"] - 1).alias("skip"))
        # the first entry, which no edge leads to, is not on the path
        return F.when((acc["skip"] == 0) & (edge > 0), taken).otherwise(passed)

    return _folded(F.reverse(best), {"skip": F.lit(0)}, step, lambda s: {"skip": s["skip"]}, lambda acc: acc["listed"])


def encode_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """(key, first, ids): the best path through the lattice of each word of (key, word, first).

    If ``words`` is dealt by key already, edges are grouped where they are made,
    without another exchange.  The words' numbers come first in the grouping,
    because edges are made in their order: sorting them costs little.
    """
    numbered = words.select(F.monotonically_increasing_id().alias("number"), "key", "word", "first")
    lattices = edges(numbered, table).groupBy("number", "key", "first").agg(F.sort_array(F.collect_list(F.struct("edge", "score", "end", "size"))).alias("edges"))
    fallback = F.array(*[F.lit(i) for i in table.bytes])

    def raw(value: Column) -> Column:
        """Byte pieces of a code point."""
        code = F.shiftright(value, 1).cast("int")
        tail = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128
        of_bytes = F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(F.shiftright(code, 6) + 0xC0, tail(0))).when(code < 0x10000, F.array(F.shiftright(code, 12) + 0xE0, tail(6), tail(0)))
        return F.transform(of_bytes.otherwise(F.array(F.shiftright(code, 18) + 0xF0, tail(12), tail(6), tail(0))), lambda b: F.get(fallback, b))

    def ids(values: Column) -> Column:
        plain = F.transform(values, lambda v: F.shiftright(v, 1).cast("int"))
        mixed = F.flatten(F.transform(values, lambda v: F.when(v % 2 == 0, F.array(F.shiftright(v, 1).cast("int"))).otherwise(raw(v))))
        return F.when(F.exists(values, lambda v: v % 2 == 1), mixed).otherwise(plain)

    return lattices.select("key", "first", bind(F.reverse(traced(best_edges(F.col("edges"), table.longest))), ids).alias("ids"))


def _joined(texts: pa.Table, words: pa.Table, decoder: Decoder | None = None) -> pa.Table:
    """(doc_id, ids) of one part: its texts as word numbers, and the ids of its words; with the decoder, the text of the ids too."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())][: 3 if decoder else 2])
    if not texts.num_rows:
        return schema.empty_table()
    of_word = words.column("ids").combine_chunks()
    number = words.column("code").to_numpy()
    begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    offsets = of_word.offsets.to_numpy()
    begin[number], size[number] = offsets[:-1], np.diff(offsets)
    flat = of_word.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    out = []
    for row in range(texts.num_rows):  # one: a part is a row
        docs, counts = (texts.column(c)[row].values for c in ("docs", "sizes"))
        until = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False), dtype=np.int64)])
        total, raw = int(until[-1]), texts.column("codes")[row].as_buffer()
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(-1, total) if total else np.zeros((0, 0), np.uint8)
        first = 0
        while first < len(docs):  # some texts at a time, which bounds the places held at once
            last = max(first + 1, int(np.searchsorted(until, until[first] + JOINED_WORDS, "right")) - 1)
            own = _numbers(planes[:, until[first] : until[last]])
            each = size[own]
            ahead = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(begin[own] - ahead[:-1], each) + np.arange(ahead[-1])] if len(own) else flat[:0]
            ends = ahead[until[first : last + 1] - until[first]]
            columns = [docs.slice(first, last - first).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
            out.append(pa.table(columns + ([decoder.texts(ids, ends)] if decoder else []), schema=schema))
            first = last
    _give_back()
    return pa.concat_tables(out) if out else schema.empty_table()


def _encoded(docs: DataFrame, table: PieceTable, text: str, part_chars: int, decoder: Decoder | None = None) -> DataFrame:
    held = _bucketed(parts(docs, table, text, part_chars), "part")
    place = F.col("part") * (1 << CODE_BITS) + F.col("code")
    listed = held.select("part", F.posexplode("words").alias("code", "word")).select(place.alias("place"), key_of(F.col("word")).alias("key"), F.when(F.length("word") > KEY_CHARS, F.col("word")).alias("long"))
    # Dealt by key alone, so that edges and ids of a word stay where the word is.  Both sides of the join use every
    # column, which makes them one exchange: the condition always holds and keeps them from being pruned.
    dealt = listed.repartition("key")
    distinct = dealt.groupBy("key", "long").agg(F.min("place").alias("first"))
    found = encode_words(distinct.select("key", F.coalesce("long", "key").alias("word"), "first"), table)
    same = F.coalesce((F.col("place") >= F.col("first")) & (F.col("long").isNull() | (F.col("first") >= 0)), F.lit(False))
    joined_words = dealt.join(found.withColumnRenamed("key", "own_key"), (F.col("key") == F.col("own_key")) & same)
    words = joined_words.select(F.shiftright("place", CODE_BITS).alias("of"), F.col("place").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int").alias("code"), F.col("ids").cast("array<smallint>" if _ids(table) < 1 << 15 else "array<int>").alias("ids"))
    texts = held.select("part", "docs", "sizes", "codes")
    shipped = docs.sparkSession.sparkContext.broadcast(decoder)  # the vocabulary, or nothing

    def joined(texts: pa.Table, words: pa.Table) -> pa.Table:
        return _joined(texts, words, shipped.value)

    return texts.groupBy("part").cogroup(words.groupBy("of")).applyInArrow(joined, "doc_id long, ids array<int>" + (", text string" if decoder else ""))


def encode(docs: DataFrame, model_path: str, text: str = "text", frequent: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids) for every row.  ``frequent`` is accepted for earlier callers; all words travel alike."""
    return _encoded(docs, load_pieces(model_path), text, part_chars)


def round_trip(docs: DataFrame, model_path: str, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids, text): every row encoded, and its ids decoded where they are laid out."""
    table = load_pieces(model_path)
    return _encoded(docs, table, text, part_chars, Decoder(table))


# ----------------------------------------------------------------- decoding
def _ids(table: PieceTable) -> int:
    return 1 + max(max(i for i, *_ in table.pieces), *table.bytes)


class Decoder:
    """Bytes of every id, laid end to end."""

    def __init__(self, table: PieceTable):
        of_id = ["�".encode()] * (_ids(table) + 1)  # the last stands for ids outside the table
        for i, p, _ in table.pieces:
            of_id[i] = p.replace(META, " ").encode()
        for b, i in enumerate(table.bytes):
            of_id[i] = bytes([b])
        self.data = np.frombuffer(b"".join(of_id), dtype=np.uint8)
        self.size = np.array([len(b) for b in of_id], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of lists of ids that lie end to end; the dummy space goes."""
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        each = self.size[ids]
        until = np.concatenate([[0], np.cumsum(each)])
        whole = self.data[np.repeat(self.begin[ids] - until[:-1], each) + np.arange(until[-1])].tobytes()
        places = until[ends]
        return pa.array([whole[a:b].decode("utf-8", "replace")[1:] for a, b in zip(places, places[1:])], pa.string())


def text_of(spark: SparkSession, model_path: str):
    """A function of an ids column: pieces and bytes put together, the dummy space removed."""
    shipped = spark.sparkContext.broadcast(Decoder(load_pieces(model_path)))  # the vocabulary

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            found = []
            for at in range(0, len(rows), 256):  # some rows at a time, which bounds the places held at once
                some = rows.slice(at, 256)
                ids = some.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([0 if n is None else n for n in pc.list_value_length(some).to_pylist()], dtype=np.int64)
                texts = shipped.value.texts(ids, np.concatenate([[0], np.cumsum(sizes)]))
                found.append(pc.if_else(some.is_valid(), texts, pa.scalar(None, pa.string())))
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    return text


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return encoded.select("doc_id", text_of(encoded.sparkSession, model_path)("ids").alias("text"))
