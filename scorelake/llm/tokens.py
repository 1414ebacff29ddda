"""Token ids in Simple-8b files.

A file holds the ids of documents in order, cut into blocks of ``BLOCK_IDS`` ids regardless of document
bounds. A block is a run of little-endian 64-bit words. The top four bits of a word select how many
ids it packs into its low 60 bits, first id lowest (``PACK``); selector 1 stands for 120 zeros, and
selector 0 is an escape: the next word is one id too wide for 60 bits. The file ends with a table of
the blocks (byte offset, words, ids), which lets a reader start at any id and decode a block's words of
one selector together, and a table of the documents (id, number of ids). Layout:

    blocks | block table | document table | counts | b"S8BLOCK1"

Each task writes the files of a doc_id range under names that sort in the order of the ids. A file is
written under a name of its own attempt and renamed, so a repeated or lost task leaves no half
file. Readers take a file a task; ``FILE_IDS`` bounds its size.

A null text is an empty one, a null doc_id comes before all others, and rows with the same id follow each other. A text
of any length is encoded whole by one task and may span blocks, but no files. Only doc_id and text are read,
whatever other columns are called. An empty table gives a folder without files, which reads as no rows."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm import files
from scorelake.llm.common import frugal, pieces, rows

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

MAGIC = b"S8BLOCK1"
ESCAPE, ZEROS, ZERO_RUN = 0, 1, 120
#: selector -> (ids in a word, bits of an id)
PACK = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12),
        12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 26
_COUNT = np.array([1, ZERO_RUN, *(n for n, _ in PACK.values())], np.int64)


_BITS = np.array(sorted(bits for _, bits in PACK.values()))  # an id of class k + 1 fits _BITS[k], class 0 is zero
_CLASS = np.append(0, np.searchsorted(_BITS, np.frexp(np.arange(1, 1 << 16))[1]) + 1).astype(np.uint8)


def _choices(ids: np.ndarray) -> np.ndarray:
    """The selector with the most ids at every place. The widest id of each stretch comes from stretches half as
    long; past the end everything fits."""
    classes = np.zeros(len(ids) + ZERO_RUN, np.uint8)
    if len(ids) and int(ids.max()) < len(_CLASS):
        classes[:len(ids)] = _CLASS[ids.astype(np.int64)]
    else:
        classes[:len(ids)] = np.searchsorted(np.uint64(1) << _BITS.astype(np.uint64), ids, side="right") + (ids > 0)
    widest = {1: classes}
    while 2 * max(widest) <= ZERO_RUN:
        n = max(widest)
        widest[2 * n] = np.maximum(widest[n][:-n], widest[n][n:])

    def stretch(n: int) -> np.ndarray:
        half = 1 << (n.bit_length() - 1)
        both = widest[half] if half == n else np.maximum(widest[half][:-(n - half)], widest[half][n - half:])
        return both[:len(ids)]

    choice = np.zeros(len(ids), np.uint8)  # escape unless something fits
    for selector in sorted(PACK, reverse=True):
        count, bits = PACK[selector]
        np.putmask(choice, stretch(count) <= np.searchsorted(_BITS, bits) + 1, selector)
    np.putmask(choice, stretch(ZERO_RUN) == 0, ZEROS)
    return choice.astype(np.int64)


def pack(ids: np.ndarray) -> np.ndarray:
    """One block: the words of unsigned 64-bit ids. At each place the selector with the most ids that
    fit is taken; the last word may be padded with zeros."""
    n = len(ids)
    choice = _choices(ids)
    place = np.arange(n)
    step = (place + _COUNT[choice]).tolist()
    heads, at = [], 0
    while at < n:
        heads.append(at)
        at = step[at]
    heads = np.array(heads, np.int64)
    selectors = choice[heads]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.zeros(ZERO_RUN, np.uint64))
    for selector, (count, bits) in PACK.items():
        those = np.flatnonzero(selectors == selector)
        for k in range(count if len(those) else 0):
            words[those] |= padded[heads[those] + k] << np.uint64(k * bits)
    escaped = np.flatnonzero(selectors == ESCAPE)
    return np.insert(words, escaped + 1, ids[heads[escaped]]) if len(escaped) else words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(selectors == ESCAPE).tolist():
        if not raw[i]:  # the raw word after an escape may itself look like one
            raw[i + 1] = True
    heads = np.flatnonzero(~raw[:-1])
    kinds = selectors[heads]
    ends = np.cumsum(_COUNT[kinds])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - _COUNT[kinds]
    for selector, (count, bits) in PACK.items():
        those = np.flatnonzero(kinds == selector)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(those) else 0):
            out[begin[those] + k] = (words[heads[those]] >> np.uint64(k * bits)) & mask
    escaped = np.flatnonzero(kinds == ESCAPE)
    out[begin[escaped]] = words[heads[escaped] + 1]
    return out[:n]


class Writer:
    """Streams documents into one file; keeps the tables and one block in memory."""

    def __init__(self, sink):
        self.sink, self.at, self.pending, self.waiting = sink, 0, [], 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, 0, len(ids)) if doc_id is None else (1, doc_id, len(ids)))
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint64)
        whole = len(ids) if all_of_it else len(ids) // BLOCK_IDS * BLOCK_IDS
        for start in range(0, whole, BLOCK_IDS):
            part = ids[start:min(start + BLOCK_IDS, whole)]
            words = pack(part)
            self.sink.write(words.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(part)))
            self.at += 8 * len(words)
        self.pending = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        for table in (self.blocks, self.docs):
            self.sink.write(np.array(table, "<i8").reshape(-1, 3).tobytes())
        self.sink.write(struct.pack("<3q", len(self.blocks), len(self.docs), self.ids) + MAGIC)


class Reader:
    """Random access to one file through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail = read(size - 32, 32)
        if tail[24:] != MAGIC:
            raise ValueError("not a token file")
        n_blocks, n_docs, self.ids = struct.unpack("<3q", tail[:24])
        tables = np.frombuffer(read(size - 32 - 24 * (n_blocks + n_docs), 24 * (n_blocks + n_docs)), "<i8").reshape(-1, 3)
        self.blocks, self.docs = tables[:n_blocks], tables[n_blocks:]
        self.ends = np.cumsum(self.blocks[:, 2])

    def block(self, k: int) -> np.ndarray:
        at, words, n = self.blocks[k].tolist()
        return unpack(np.frombuffer(self.read(at, 8 * words), "<u8"), n)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, decoding only the blocks that hold them."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.empty(0, np.uint64)
        first, last = np.searchsorted(self.ends, [start, stop - 1], side="right").tolist()
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - (int(self.ends[first - 1]) if first else 0):][:stop - start]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, number of ids, the ids in parts) in order, decoding each block once. The parts of a
        document must be read before the next one is asked for."""
        blocks = (self.block(k) for k in range(len(self.blocks)))
        rest = np.empty(0, np.uint64)

        def take(n: int) -> Iterator[np.ndarray]:
            nonlocal rest
            while n:
                if not len(rest):
                    rest = next(blocks)
                part, rest = rest[:n], rest[n:]
                n -= len(part)
                yield part

        for known, doc_id, n in self.docs.tolist():
            yield doc_id if known else None, n, take(n)


class _Words(dict):
    """The ids of words with the space or line end before them, learned when first asked for. A letter run with
    its space is one piece for the pre-tokenizer and goes straight to the model, in the byte alphabet; a line end,
    letters without a space and a run of signs are pieces too, so such words are put together. Others go through the
    library."""

    plain = re.compile(r"(\n?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, encoder: Encoder):
        self.library, self.tokenize = encoder.library, encoder.library.model.tokenize
        self.newline = self._of("\n")
        self.signs: dict[str, bytes] = {}
        same = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
        others = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in same else chr(next(others)) for b in range(256)}

    def _of(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        match = self.plain(word)
        if match is None:
            ids = self._of(word if word[:1] == "\n" else " " + word)
        else:
            run, signs = match.groups()
            if signs:
                tail = self.signs.get(signs)
                if tail is None:
                    tail = self.signs[signs] = self._of(signs)
                ids = self[run] + tail
            else:
                head, text = (self.newline, run[1:]) if run[0] == "\n" else (b"", " " + run)
                made = [x.id for x in self.tokenize(text.encode().decode("latin-1").translate(self.alphabet))]
                ids = head + struct.pack(f"<{len(made)}I", *made)
        self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.signs.clear()


class Encoder:
    """Exactly the library's ids of whole texts, remembered words encoded once. The pre-tokenizer of
    a byte-level vocabulary never joins two words across a single space or line end between two signs that are
    no white space, so a text is cut there and each part, with what precedes it, is looked up or encoded by the
    library. Texts with a special token's name go to the library whole."""

    LIMIT = 1_500_000  # remembered words, about 160 bytes each

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        before = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["model"].get("dropout")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.odd = re.compile(r" (?:(?=\s)|(?<=\s ))|\n(?:(?!\S)|(?<!\S\n))")  # a space or line end beside white space
        self.known = _Words(self)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[tuple[int, str, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not self.by_word or any(s in text for s in self.special):
                whole.append(i)
            else:
                head, *words = self.cut.split(text) if self.odd.search(text) else text.replace("\n", " \n").split(" ")
                plain.append((i, head, words))
        if len(self.known) > self.LIMIT:
            self.known.clear()
        heads = list({head for _, head, _ in plain if head})
        first = dict(zip(heads, self._whole(heads), strict=True)) if heads else {}
        get = self.known.__getitem__
        for i, head, words in plain:
            ids = np.array(first.get(head, ()), "<u4").tobytes()
            out[i] = np.frombuffer(ids + b"".join(map(get, words)), "<u4")
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
                out[i] = np.array(ids, "<u4")
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_FILES = pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _writes(folder: str, vocabulary: str, end_id: int | None, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part, roll, writer, sink = files.Store(folder), TaskContext.get().partitionId(), 0, None, None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal writer, roll
            writer.close()
            name = f"ids-{part:08d}-{roll:06d}.s8b"
            sink.commit(name)
            done.append((f"{folder}/{name}", len(writer.docs), writer.ids))
            writer, roll = None, roll + 1

        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(texts), strict=True):
                    if writer is None:
                        sink = store.create()
                        writer = Writer(sink)
                    ids = ids.astype(np.uint64)
                    writer.add(doc_id, ids if end_id is None else np.append(ids, np.uint64(end_id)))
                    if writer.ids >= file_ids:
                        finish()
        if writer is not None:
            finish()
        yield rows(_FILES, *zip(*done, strict=True)) if done else rows(_FILES, [], [], [])

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text (null: empty) and write files in ascending doc_id order. Rows without
    an id come first; rows with equal ids follow each other in the order of their texts' hashes, so
    a repeated id may span tasks. Returns a lazy (path, n_docs, n_ids): writing happens when it is read."""
    files.Store(folder)  # exists even without rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(frugal(_writes(folder.rstrip("/"), vocabulary, end_id, file_ids)), "path string, n_docs long, n_ids long")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        yield rows(_FILES, paths, *zip(*((len(r.docs), r.ids) for r in (Reader(*files.opened(p)) for p in paths)), strict=True)) if paths else rows(_FILES, [], [], [])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out: list[tuple] = []
            for doc_id, n, parts in Reader(*files.opened(path)).documents():
                crc = 0
                for part in parts:
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                out.append((doc_id, start, n, crc))
                start += n
                if len(out) == 10_000:
                    yield rows(_DOCS, *zip(*out, strict=True))
                    out = []
            if out:
                yield rows(_DOCS, *zip(*out, strict=True))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_docs, n_ids, start) of a folder's files, from their own tails; start counts the ids of
    all files before. The window runs over one row a file."""
    found = files.listing(spark, folder, "*.s8b")
    sized = found.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_sizes, "path string, n_docs long, n_ids long")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder's files; ids must fit 32 bits."""
    placed = token_files(spark, folder).select("path", "start")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(frugal(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")
