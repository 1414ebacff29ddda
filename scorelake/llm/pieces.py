"""Offset-preserving SentencePiece encoding, and decoding.

Normalisation is done here: at each place the longest prefix that the model's compiled character map
knows is replaced, everything else is copied, and the source place of every normalised byte is kept.
The library segments the text; its pieces, laid end to end over the normalised text, are projected
through that alignment to spans of bytes in the original text. Spans of one text are contiguous.

A model whose pieces never hold a space sign after another sign (``by_word``) cannot merge across the
start of a word, so each distinct word is segmented once; other models get whole texts.

Null texts count as empty and have no ids. Rows are independent: repeated rows, ties and null ids
change nothing, other columns are ignored, an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import pieces as parts_of
from scorelake.llm.common import frugal, rows

SIGN = "▁"  # how a model writes a space


class CharMap:
    """The replacements of a compiled character map: a double-array trie over UTF-8 bytes whose values
    point into a block of zero-ended strings."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, str] = {}
        if blob:
            size, = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size:]
            self._walk()
        ones = {k for k in self.rules if len(k) == 1}
        seconds = {k[1] for k in self.rules if len(k) > 1}
        self.longest = max(map(len, self.rules), default=0)
        choices = ([f"[{self._set(ones)}]"] if ones else []) + ([f"[\\s\\S](?=[{self._set(seconds)}])"] if seconds else [])
        self.maybe = re.compile("|".join(choices)) if choices else None

    @staticmethod
    def _set(signs: set[str]) -> str:
        return "".join(f"\\U{ord(c):08x}" for c in sorted(signs))

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _walk(self) -> None:
        """Every key of the trie, depth first."""
        stack = [(0, b"")]
        while stack:
            node, key = stack.pop()
            below = node ^ self._base(self.units[node])
            if self.units[node] >> 8 & 1:
                start = self.units[below] & (1 << 31) - 1
                self.rules[key.decode()] = self.texts[start:self.texts.index(b"\0", start)].decode()
            for c in range(1, 256):
                child = below ^ c
                if child < len(self.units) and self.units[child] & (1 << 31 | 0xFF) == c:
                    stack.append((child, key + bytes([c])))

    def changes(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, replacement) of each longest match, left to right."""
        at = 0
        while self.maybe is not None and (m := self.maybe.search(text, at)):
            at = m.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.rules.get(text[at:at + n])) is not None:
                    yield at, at + n, new
                    at += n
                    break
            else:
                at += 1


class Spec(NamedTuple):
    charmap: bytes
    dummy_prefix: bool
    trim: bool  # extra white space is removed
    escape: bool  # spaces become SIGN
    suffix: bool  # white space stands after words
    byte_fallback: bool
    user_defined: tuple[str, ...]
    by_word: bool


def read_spec(path: str) -> Spec:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    own = tuple(p.piece for p in model.pieces if p.type == 4)
    inner = any(SIGN in p.piece.lstrip(SIGN) for p in model.pieces)
    by_word = train.model_type == 2 and not inner and not own and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces and not train.treat_whitespace_as_suffix and not norm.precompiled_charsmap
    return Spec(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces,
                train.treat_whitespace_as_suffix, train.byte_fallback, own, by_word)


class Normalised(NamedTuple):
    text: bytes
    source: np.ndarray  # for each normalised byte and the end, the byte of the original it starts from


class Normaliser:
    def __init__(self, spec: Spec):
        self.spec, self.map = spec, CharMap(spec.charmap)
        self.own = re.compile("|".join(map(re.escape, sorted(spec.user_defined, key=len, reverse=True)))) if spec.user_defined else None

    def runs(self, text: str) -> Iterator[tuple[str, str]]:
        """(original, normalised) pieces; equal strings are plain copies of any length."""
        kept = [(m.start(), m.end()) for m in self.own.finditer(text)] if self.own else []
        at = 0
        for lo, hi in [*kept, (len(text), len(text))]:
            stretch = text[at:lo]
            done = 0
            for start, end, new in self.map.changes(stretch):
                if start > done:
                    yield stretch[done:start], stretch[done:start]
                yield stretch[start:end], new
                done = end
            if done < len(stretch):
                yield stretch[done:], stretch[done:]
            if hi > lo:
                yield text[lo:hi], text[lo:hi]
            at = hi

    def __call__(self, text: str) -> Normalised:
        original = text.encode()
        if self.map.maybe is None and self.own is None:
            out, source = np.frombuffer(original, np.uint8), np.arange(len(original), dtype=np.int64)
        else:
            chunks, sources, at = [], [], 0
            for old, new in self.runs(text):
                a, b = old.encode(), new.encode()
                chunks.append(b)
                sources.append(at + np.arange(len(a)) if old == new else np.full(len(b), at))
                at += len(a)
            out = np.frombuffer(b"".join(chunks), np.uint8)
            source = np.concatenate(sources).astype(np.int64) if sources else np.empty(0, np.int64)
        end = len(original)
        if self.spec.trim:
            space = out == 32
            keep = np.flatnonzero(~space)
            if not len(keep):
                return Normalised(b"", np.array([end]))
            inside = slice(int(keep[0]), int(keep[-1]) + 1)
            end = int(source[keep[-1] + 1]) if keep[-1] + 1 < len(source) else end
            out, source, space = out[inside], source[inside], space[inside]
            single = np.ones(len(out), bool)
            single[1:] = ~(space[1:] & space[:-1])
            out, source = out[single], source[single]
        if not len(out):
            return Normalised(b"", np.array([end]))
        if self.spec.dummy_prefix:
            ends = self.spec.suffix
            out = np.append(out, np.uint8(32)) if ends else np.insert(out, 0, 32)
            source = np.append(source, end) if ends else np.insert(source, 0, source[0])
        if self.spec.escape:
            width = np.where(out == 32, 3, 1)
            source = np.repeat(source, width)
            return Normalised(out.tobytes().replace(b" ", SIGN.encode()), np.append(source, end))
        return Normalised(out.tobytes(), np.append(source, end))


class Codec:
    LIMIT = 200_000  # remembered words

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spec = read_spec(path)
        self.normalise = Normaliser(self.spec)
        n = self.library.get_piece_size()
        self.length = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.unknown = self.library.unk_id()
        self.surface = [bytes([int(self.library.id_to_piece(i)[1:-1], 16)]) if self.library.is_byte(i) else self.library.id_to_piece(i).encode() for i in range(n)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(n)])
        self.known: dict[str, bytes] = {}
        self.runs = re.compile(r" *[^ ]+")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of whole texts."""
        out: list[np.ndarray | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not self.spec.by_word or SIGN in text or text[-1:] == " ":
                whole.append(i)
            elif "  " not in text and text[:1] != " ":
                cut.append((i, text.split(" ") if text else []))
            else:  # a word's first space is the one the library puts before every text
                cut.append((i, [w[1:] for w in self.runs.findall(" " + text)]))
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known = self.known
        new = list({w for _, words in cut for w in words}.difference(known))
        for at in range(0, len(new), 5000):
            part = new[at:at + 5000]
            known.update((w, np.array(x, "<i4").tobytes()) for w, x in zip(part, self.library.encode(part, num_threads=1), strict=True))
        for i, words in cut:
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")
        for i, x in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1) if whole else (), strict=True):
            out[i] = np.array(x, "<i4")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """A row (start, end) of original bytes for each id. An unknown piece covers what the pieces
        around it leave: its length is read off the library's own pieces."""
        if not len(ids):
            return np.empty((0, 2), np.int64)
        made = self.normalise(text)
        length = self.length[ids]
        if (ids == self.unknown).any():
            names = self.library.encode(text, out_type=str)
            length = np.array([len(n.encode()) if i == self.unknown else k for n, i, k in zip(names, ids.tolist(), length.tolist(), strict=True)], np.int64)
        ends = np.cumsum(length)
        if ends[-1] != len(made.text):
            raise ValueError("pieces do not cover the normalised text")
        bounds = made.source[np.append(0, ends)]
        bounds[0], bounds[-1] = 0, len(text.encode())
        return np.stack([bounds[:-1], bounds[1:]], axis=1)


    def aligned(self, text: str, ids: np.ndarray, spans: np.ndarray) -> bool:
        """Whether the spans lie side by side over the whole text, and each piece is what becomes of the original
        bytes of its span: put back together from them, the pieces are those of the ids."""
        data = text.encode()
        if not len(ids):
            return not self.normalise(text).text
        if spans[0, 0] != 0 or spans[-1, 1] != len(data) or (spans[1:, 0] != spans[:-1, 1]).any():
            return False
        spec = self.spec
        if spec.charmap or spec.user_defined or spec.trim or spec.suffix or not (spec.dummy_prefix and spec.escape) or (ids == self.unknown).any():
            return all(self._made_of(data[a:b], i) for (a, b), i in zip(spans.tolist(), ids.tolist(), strict=True))
        spaces = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) == 32))  # a space becomes three bytes, and one comes first
        places = spans[:, 1] + 2 * spaces[spans[:, 1]] + 3
        whole = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return bool((places == np.cumsum(self.length[ids])).all()) and whole == (b" " + data).replace(b" ", SIGN.encode())

    def _made_of(self, data: bytes, i: int) -> bool:
        if i == self.unknown or self.is_byte[i]:
            return i == self.unknown or bool(self.spec.charmap) or data in (self.surface[i], b"")
        made = "".join(new for _, new in self.normalise.runs(data.decode()))
        return " ".join(made.replace(SIGN, " ").split(" ")).strip(" ") == self.surface[i].decode().replace(SIGN, " ").strip(" ")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                     ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("aligned", pa.bool_())])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32), flat)


def _encodes(path: str, with_ids: bool, with_spans: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for whole in batches:
            for batch in parts_of(whole, "text", 1 << 19):
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                ids = tool.ids(texts)
                spans = [tool.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                decoded = tool.decode(ids)
                none = pa.nulls(len(texts), pa.list_(pa.int32()))
                yield rows(_SCHEMA, batch.column(0), [len(x) for x in ids], _lists(ids) if with_ids else none, *([_lists([s[:, k] for s in spans]) for k in (0, 1)] if with_spans else [none] * 2),
                           [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids], [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                           [len(t.encode()) for t in texts], [tool.aligned(t, x, s) for t, x, s in zip(texts, ids, spans, strict=True)])

    return encode


def encoded(docs: DataFrame, path: str, ids: bool = True, spans: bool = True) -> DataFrame:
    """For every row: doc_id, n_tokens, the ids and their byte spans in the text (starts, ends; null
    lists where not asked for), digests of the ids and of the decoded text, the text's bytes, and
    whether the pieces put back together from the spans' original bytes are those of the ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(frugal(_encodes(path, ids, spans)), "doc_id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>, "
                                                   "ids_sha256 string, decoded_sha256 string, n_bytes long, aligned boolean")
