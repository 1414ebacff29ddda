"""Benchmark decontamination over a positional inverted index.

The index is distributed by documents. A shard is a run of texts of about ``SHARD_BYTES``; it numbers its words
through, with a gap after each text, and holds for every term the ascending places where it stands: term,
number of places, places. Shards are rows of a table in the shared folder, so an index is built once and searched
for any benchmark. A long text is cut into slices of about ``SHARD_BYTES`` that repeat the last ``reach`` - 1 words of
the slice before, so every phrase of up to ``reach`` words lies whole in one slice.

Test items are cut into windows of ``width`` consecutive words (an item of fewer words is one window). In a shard
a window's terms are taken from the rarest on: the rarest one's places, less its offset in the window, are
the candidate starts, and each further term's places, less its own offset, are intersected with them. A window
with a term that the shard lacks costs one look-up. With ``slop`` the match is by proximity: the terms in order,
within ``slop`` words more than they take as a phrase; around every place of the rarest term the nearest places
of its neighbours give the shortest such span.

No postings are shuffled, and a frequent word or passage is no key of anything: a shard's lists are as long as
its text at most. Windows lie in the shared folder in blocks of ``BLOCK_WINDOWS``; a task reads block by block
and searches its shards for each, so a benchmark of any size needs bounded memory.

A word is a run of bytes other than ASCII signs, after A-Z are lower-cased; terms are 64-bit hashes of words.
Null texts have no words; documents without words are returned without hits. Every row of the documents is a document of its
own, whatever its (whole-number) doc_id. Items with the same id count once; an item with a null id counts under the empty name.
Other columns are ignored. Without documents there are no rows, without items no hits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import files
from scorelake.llm.common import frugal, materialise, pieces, rows
from scorelake.llm.words import mix, stream

WIDTH = 10
SHARD_BYTES = 2 << 20
BLOCK_WINDOWS = 1 << 15

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_BYTE = stream(21, 256) | np.uint64(1)
_PLACE = stream(22, 1 << 8) | np.uint64(1)
_LENGTH = stream(23, 1)[0]


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and term of each word."""
    raw = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.take(_LETTER, raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    length = stops - starts
    letters = np.flatnonzero(inside[1:-1])
    first = np.cumsum(length) - length
    within = np.arange(len(letters)) - np.repeat(first, length)
    sums = np.add.reduceat(_BYTE[raw[letters]] * _PLACE[np.minimum(within, len(_PLACE) - 1)], first)
    for i in np.flatnonzero(length > len(_PLACE)):
        sums[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:stops[i]].tobytes())
    return starts, mix(sums + length.astype(np.uint64) * _LENGTH)


class Block:
    """Some windows of up to ``width`` terms: the different ones, as numbers of the ``asked`` terms, and the items of each."""

    def __init__(self, items: list[str], lengths: np.ndarray, table: np.ndarray):
        different, back = np.unique(np.column_stack([lengths.astype(np.int64), table]), axis=0, return_inverse=True)
        back = back.ravel()
        self.items, self.lengths = items, different[:, 0]
        asked, number = np.unique(np.ascontiguousarray(different[:, 1:]).view(np.uint64), return_inverse=True)
        self.asked, self.terms = asked, number.reshape(len(different), -1)
        self.of = np.argsort(back, kind="stable")
        self.some = np.bincount(back, minlength=len(different))
        self.begin = np.cumsum(self.some) - self.some

    def named(self, windows: np.ndarray) -> list[str]:
        """The items of some windows."""
        return sorted({self.items[i] for w in windows for i in self.of[self.begin[w]:self.begin[w] + self.some[w]]})


class Text(NamedTuple):
    """A slice of a document: its words from number ``word`` on; the first ``again`` are those of the slice before."""

    row: int
    doc_id: int | None
    word: int
    again: int
    terms: np.ndarray


def _slices(row: int, doc_id: int | None, data: bytes, reach: int, limit: int) -> Iterator[Text]:
    at, word, tail = 0, 0, np.empty(0, np.uint64)
    while True:
        end = min(at + limit, len(data))
        while end < len(data) and _LETTER[_FOLD[data[end]]]:
            end += 1
        new = terms(data[at:end])[1]
        whole = np.concatenate([tail, new])
        yield Text(row, doc_id, word - len(tail), len(tail), whole)
        word, at = word + len(new), end
        if at >= len(data):
            return
        tail = whole[max(0, len(whole) - reach + 1):] if reach > 1 else tail


class Shard:
    """The postings of some texts. ``gap`` free places follow each text."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, places: np.ndarray, firsts: np.ndarray, sizes: np.ndarray):
        self.names, self.counts, self.places, self.firsts, self.sizes = names, counts, places, firsts, sizes
        self.begin = np.cumsum(counts) - counts
        self.keys = (np.repeat(np.arange(len(names), dtype=np.int64), counts) << 32) + places

    @staticmethod
    def postings(texts: list[Text], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms, their numbers of places, the places by term, and each text's first place."""
        sizes = np.array([len(t.terms) for t in texts], np.int64)
        firsts = np.cumsum(sizes + gap) - sizes - gap
        every = np.concatenate([t.terms for t in texts])
        places = np.arange(len(every)) + np.repeat(np.arange(len(texts)) * gap, sizes)
        order = np.argsort(every, kind="stable")
        every = every[order]
        heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
        return every[heads], np.diff(np.append(heads, len(every))), places[order], firsts

    def _rarest_first(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows whose terms all occur here, their terms' numbers, and their offsets by rising frequency."""
        width = block.terms.shape[1]
        if not len(self.names):
            return np.empty(0, np.int64), np.empty((0, width), np.int64), np.empty((0, width), np.int64)
        number = np.minimum(np.searchsorted(self.names, block.asked), len(self.names) - 1)
        number = np.where(self.names[number] == block.asked, number, -1)[block.terms]
        beyond = np.arange(width) >= block.lengths[:, None]
        alive = np.flatnonzero(((number >= 0) | beyond).all(axis=1))
        number, beyond = number[alive], beyond[alive]
        order = np.argsort(np.where(beyond, 1 << 40, self.counts[number]), axis=1, kind="stable")
        return alive, number, order

    def _candidates(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked term, its places: number of the asking one, place."""
        some = self.counts[term]
        who = np.repeat(np.arange(len(term)), some)
        return who, self.places[np.repeat(self.begin[term] - np.cumsum(some) + some, some) + np.arange(len(who))]

    def _has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) + place
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every exact occurrence."""
        alive, number, order = self._rarest_first(block)
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        line = np.arange(len(alive))
        who, start = self._candidates(number[line, order[:, 0]])
        start = start - order[who, 0]
        who, start = who[start >= 0], start[start >= 0]
        for j in range(1, block.terms.shape[1]):
            more = j < block.lengths[alive[who]]
            offset = order[who, j]
            keep = ~more
            keep[more] = self._has(number[who[more], offset[more]], start[more] + offset[more])
            who, start = who[keep], start[keep]
        return alive[who], start

    def near(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first place, last place) of the shortest ordered span around each place of a window's rarest
        term, where it is at most ``slop`` words longer than the phrase."""
        alive, number, order = self._rarest_first(block)
        if not len(alive):
            return (np.empty(0, np.int64),) * 3
        lengths = block.lengths
        line = np.arange(len(alive))
        who, place = self._candidates(number[line, order[:, 0]])
        anchor = order[who, 0]
        low, high = place.copy(), place.copy()
        fine = np.ones(len(who), bool)
        for step in range(1, block.terms.shape[1]):
            for side in (-1, 1):
                at = anchor + side * step
                todo = np.flatnonzero(fine & (at >= 0) & (at < lengths[alive[who]]))
                term = number[who[todo], at[todo]]
                key = (term << 32) + (low if side < 0 else high)[todo]
                found = np.searchsorted(self.keys, key, "left") - 1 if side < 0 else np.searchsorted(self.keys, key, "right")
                same = (found >= 0) & (found < len(self.keys))
                same[same] = self.keys[found[same]] >> 32 == term[same]
                fine[todo[~same]] = False
                (low if side < 0 else high)[todo[same]] = self.keys[found[same]] & 0xFFFFFFFF
        one_text = np.searchsorted(self.firsts, low, "right") == np.searchsorted(self.firsts, high, "right")
        fine &= one_text & (high - low < lengths[alive[who]] + slop)
        return alive[who[fine]], low[fine], high[fine]


_INDEX = pa.schema([("texts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("again", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("names", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_INDEX_DDL = "texts array<long>, doc_ids array<long>, words array<long>, again array<long>, sizes array<long>, firsts array<long>, names binary, counts binary, places binary"


def _packed(texts: list[Text], reach: int) -> pa.RecordBatch:
    names, counts, places, firsts = Shard.postings(texts, reach)
    facts = [[t.row for t in texts], [t.doc_id for t in texts], [t.word for t in texts], [t.again for t in texts], [len(t.terms) for t in texts], firsts.tolist()]
    return rows(_INDEX, *([f] for f in facts), [names.tobytes()], [counts.astype("<u4").tobytes()], [places.astype("<u4").tobytes()])


def index(docs: DataFrame, reach: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder, one row a shard. Matches of up to ``reach`` words,
    slop included, can be found in it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Text] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                for row, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    data = value.as_buffer().to_pybytes() if value.is_valid else b""
                    for part in _slices(row, doc_id, data, reach, SHARD_BYTES):
                        held.append(part)
                        size += min(len(data), SHARD_BYTES) + 64
                        if size >= SHARD_BYTES:
                            yield _packed(held, reach)
                            held, size = [], 0
        if held:
            yield _packed(held, reach)

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialise(slim.mapInArrow(frugal(build), _INDEX_DDL))


def windows(items: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, terms) of every window of every item; terms are padded with zeros to ``width``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = terms((value or "").encode())[1].view(np.int64)
                    size = min(width, len(words))
                    for at in range(0, len(words) - size + 1, BLOCK_WINDOWS) if size else ():
                        some = np.lib.stride_tricks.sliding_window_view(words[at:at + BLOCK_WINDOWS + size - 1], size)
                        full = np.zeros((len(some), width), np.int64)
                        full[:, :size] = some
                        lists = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), width).cast(pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([size] * len(some), pa.int32()), lists], names=["item", "length", "terms"])

    named = items.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return named.mapInArrow(frugal(cut), "item string, length int, terms array<long>")


def _blocks(paths: list[str], width: int) -> Iterator[Block]:
    for path in paths:
        fs, place = files.resolve(path)
        with fs.open_input_file(place) as source:
            for batch in pq.ParquetFile(source).iter_batches(BLOCK_WINDOWS):
                if len(batch):
                    yield Block(batch.column("item").to_pylist(), batch.column("length").to_numpy(), batch.column("terms").flatten().to_numpy().reshape(-1, width))


_HITS = pa.schema([("row", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans [low, high) joined."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    head = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    return low[head], reach[np.append(head[1:], len(low)) - 1]


def _found(shard: Shard, texts: np.ndarray, words: np.ndarray, block: Block, slop: int) -> Iterator[tuple[int, list, list]]:
    """(row, spans, items) of every text of the shard with a match in the block."""
    if slop:
        window, low, high = shard.near(block, slop)
        high = high + 1
    else:
        window, low = shard.phrases(block)
        high = low + block.lengths[window]
    text = np.searchsorted(shard.firsts + shard.sizes, low, "right")
    order = np.argsort(text, kind="stable")
    text, window, low, high = text[order], window[order], low[order], high[order]
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
    for begin, end in zip(heads, np.append(heads[1:], len(text)) if len(text) else [], strict=True):
        k = text[begin]
        spans = _united(low[begin:end] - shard.firsts[k] + words[k], high[begin:end] - shard.firsts[k] + words[k])
        yield int(texts[k]), [{"start": int(a), "stop": int(b)} for a, b in zip(*spans, strict=True)], block.named(np.unique(window[begin:end]))


def search(shards: DataFrame, test: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """(row, hits, items) of the documents of an index in which a window of ``test`` occurs: the spans of hit words
    [start, stop) and the items. A document has a row for every shard and block of windows that matched."""
    written = materialise(test)
    paths = sorted(written.inputFiles())

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = []
            for r in range(len(batch)):
                texts, words, sizes, firsts = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("texts", "words", "sizes", "firsts"))
                names, counts, places = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("names", "<u8"), ("counts", "<u4"), ("places", "<u4")))
                opened.append((texts, words, sizes, firsts, names, counts, places))
            for block in _blocks(paths, width):
                for texts, words, sizes, firsts, names, counts, places in opened:
                    shard = Shard(names, counts.astype(np.int64), places.astype(np.int64), firsts, sizes)
                    hits = list(_found(shard, texts, words, block, slop))
                    if hits:
                        yield rows(_HITS, *zip(*hits, strict=True))

    return shards.mapInArrow(frugal(seek), "row long, hits array<struct<start:long,stop:long>>, items array<string>")


def covered(hits: Column) -> Column:
    """The number of words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), span["stop"] - F.greatest(seen["end"], span["start"]))
        return F.struct(F.greatest(seen["end"], span["stop"]).alias("end"), (seen["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(hits), start, add, lambda seen: seen["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, hits, items) of every document: the spans of its hit words (those of different slices
    may overlap), and the sorted names of the items with a match."""
    shards = index(docs, width + slop)
    found = search(shards, windows(items, width), width, slop)
    each = shards.select(F.explode(F.arrays_zip("texts", "doc_ids", "sizes", "again")).alias("t"))
    each = each.select(F.col("t.texts").alias("row"), F.col("t.doc_ids").alias("doc_id"), (F.col("t.sizes") - F.col("t.again")).alias("n"))
    both = each.unionByName(found, allowMissingColumns=True).groupBy("row")
    made = both.agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return made.select("doc_id", "n_words", "hits", F.array_sort(F.array_distinct("items")).alias("items"))
