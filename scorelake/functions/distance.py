"""Edit distance for short and long sequences.

Spark's ``levenshtein`` is right for names and field values, but it is a full table walk:
two 20,000-word texts take minutes. Long pairs go through one Arrow UDF that keeps a whole
column of that table in the bits of one integer (Hyyrö's bit-vector form of Myers'
algorithm) and only the rows near the diagonal of it, which is exact. Pairs whose edits are all
replacements or all omissions are settled by counting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text import UNIT_SEPARATOR, joined_aksharas

SHORT_CELLS = 40_000  # below this table size the built-in function wins
#: Signs for the units that two short sequences share: the shorter one has at most the root of SHORT_CELLS.
SIGNS = [chr(0x100 + i) for i in range(200)]


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal where the symbols are."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    known = {s: i for i, s in enumerate({*a, *b})}
    return tuple(np.fromiter(map(known.__getitem__, x), np.uint32, len(x)) for x in (a, b))


def _surplus(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many symbols each side has beyond those of the other, whatever their places."""
    size = int(max(a.max(), b.max())) + 1
    if size > 1 << 16:  # far code points: number them first
        both = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
        a, b, size = both[:len(a)], both[len(a):], int(both.max()) + 1
    spare = np.bincount(a, minlength=size) - np.bincount(b, minlength=size)
    return int(spare[spare > 0].sum()), int(-spare[spare < 0].sum())


def _kinds_left_out(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the second is the first without all symbols of some kinds."""
    kept = np.zeros(int(max(a.max(), b.max())) + 1, bool)
    kept[b] = True
    return np.array_equal(a[kept[a]], b)


def bit_distance(a, b) -> int:
    """Levenshtein distance of two sequences of hashable symbols.

    Between equal ends, the symbols one side has too many of bound the distance from below. Texts that differ by
    replaced symbols only (place by place) or by left-out ones only reach that bound, and need no table; the others
    take a band of it, widened until it must hold a cheapest path."""
    if a == b:
        return 0
    a, b = _codes(a, b)
    limit = min(len(a), len(b))
    differ = np.flatnonzero(a[:limit] != b[:limit])
    start = int(differ[0]) if len(differ) else limit
    differ = np.flatnonzero(a[len(a) - limit + start:][::-1] != b[len(b) - limit + start:][::-1])
    end = int(differ[0]) if len(differ) else limit - start
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    more, fewer = _surplus(a, b)
    if len(a) == len(b) and int(np.count_nonzero(a != b)) == more:
        return more
    if not fewer and _kinds_left_out(a, b):
        return more
    listed = a.tolist(), b.tolist()
    if not fewer:
        rest = iter(listed[0])
        if all(symbol in rest for symbol in listed[1]):
            return more
    band = max(64, more + more // 2)
    while 3 * band + BLOCK < len(a):
        found = _within(*listed, band)
        if found <= band:
            return found
        band = min(found, 4 * band)
    return _within(*listed, len(a))


BLOCK = 256  # columns worked out on one window of rows


def _within(a: list, b: list, band: int) -> int:
    """The distance over paths that keep within ``band`` of the diagonal (an upper bound of the distance): columns of
    the table as bits, of which only the rows near the diagonal are kept. Longest first."""
    where: dict = {}
    for i, symbol in enumerate(a):
        where.setdefault(symbol, []).append(i)
    size = len(a)
    whole = {}
    for symbol in set(b):
        spots = where.get(symbol)
        if spots:
            buf = bytearray(size // 8 + 1)
            for i in spots:
                buf[i >> 3] |= 1 << (i & 7)
            whole[symbol] = int.from_bytes(buf, "little")
    low = top = high = up = down = 0  # rows [low, high) are kept, top is the value above them; rises and falls by one
    for at in range(0, len(b), BLOCK):
        part = b[at:at + BLOCK]
        first = min(max(low, at - band), size)
        if first > low:
            gone = (1 << (first - low)) - 1
            top += (up & gone).bit_count() - (down & gone).bit_count()
            up, down, low = up >> (first - low), down >> (first - low), first
        last = min(size, at + len(part) + band)
        if last > high:
            up |= ((1 << (last - high)) - 1) << (high - low)
            high = last
        every = (1 << (high - low)) - 1
        masks: dict = {}
        for symbol in part:
            same = masks.get(symbol)
            if same is None:
                same = masks[symbol] = (whole.get(symbol, 0) >> low) & every
            diagonal = (((same & up) + up) ^ up) | same | down
            plus = ((down | (every & ~(diagonal | up))) << 1) | 1
            up, down = (((diagonal & up) << 1) | ~(diagonal | plus)) & every, plus & diagonal & every
        top += len(part)
    return top + up.bit_count() - down.bit_count()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _long_distances(pred: pd.Series, refs: pd.Series, sep: pd.Series) -> pd.Series:
    def one(p, rs, s):
        if p is None or rs is None:
            return None
        split = lambda x: x if not s else x.split(s) if x else []
        units = split(p)
        return [None if r is None else bit_distance(units, split(r)) for r in rs]

    return pd.Series([one(p, rs, s) for p, rs, s in zip(pred, refs, sep)])


def unit_distances(fold: bool):
    """An Arrow function of a canonical prediction and canonical references: the akshara distance to each reference (of a
    NULL one, NULL), aksharas of each, and of the prediction. Syllables are found and compared in one place: joined to
    texts they would take four times the bytes of the text, twice to Python and back."""
    def one(pred, refs):
        p = joined_aksharas(pred, fold)
        joined = [None if r is None else joined_aksharas(r, fold) for r in refs]
        units = p.split(UNIT_SEPARATOR) if p else []
        split = [None if r is None else r.split(UNIT_SEPARATOR) if r else [] for r in joined]
        return [None if r is None else bit_distance(units, r) for r in split], [None if r is None else len(r) for r in split], len(units)

    def all_of(pred: pd.Series, refs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, rs) for p, rs in zip(pred, refs)], columns=["d", "n", "size"])

    counts = T.ArrayType(T.IntegerType())
    return F.pandas_udf(all_of, T.StructType([T.StructField("d", counts), T.StructField("n", counts), T.StructField("size", T.IntegerType())]))


def _units(text: Column, sep: str) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, sep, -1))


def _as_signs(units: Column, shared: Column, other: str) -> Column:
    """A text of one sign a unit: units of both sides by their place in ``shared``, the rest, which equal nothing
    on the other side, by one sign."""
    sign = lambda u: F.coalesce(F.get(F.lit(SIGNS), F.array_position(shared, u).cast("int") - 1), F.lit(other))
    return F.array_join(F.transform(units, sign), "")


def _unit_distance(pred: Column, ref: Column) -> Column:
    shared = F.array_intersect(pred, ref)
    return F.levenshtein(_as_signs(pred, shared, "<"), _as_signs(ref, shared, ">"))


def ref_distances(pred: Column, refs: Column, sep: str = "", reach: float | None = None) -> Column:
    """Distance from ``pred`` to every text of ``refs``; with ``sep`` over the units it
    separates (words, aksharas) instead of code points. A NULL text has a NULL distance. Equal texts
    need no comparison; short ones are compared natively. With ``reach``, a text whose length alone puts the
    similarity (1 - distance / longer length) below it is not compared and has a NULL distance."""
    if reach is not None:
        n = F.length(pred)
        refs = F.transform(refs, lambda r: F.when(F.least(n, F.length(r)) >= reach * F.greatest(n, F.length(r)), r))
    same = F.coalesce(F.forall(refs, lambda r: r == pred), F.lit(False))
    zero = F.transform(refs, lambda r: F.lit(0))
    # As many units as signs and one more at the most: counting them would cost more than it tells.
    count = F.length if not sep else lambda c: F.length(c) + 1
    longest = F.array_max(F.transform(refs, count))
    short = F.coalesce(count(pred).cast("bigint") * longest, F.lit(0)) <= SHORT_CELLS
    native = same | short
    far = _long_distances(F.when(~native, pred), F.when(~native, refs), F.lit(sep))
    if sep:
        near = F.transform(refs, lambda r: _unit_distance(_units(pred, sep), _units(r, sep)))
    else:
        near = F.transform(refs, lambda r: F.levenshtein(pred, r))
    return F.when(same, zero).when(short, near).otherwise(far)


def edit_distance(a: Column, b: Column, sep: str = "") -> Column:
    return F.element_at(ref_distances(a, F.array(b), sep), 1)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, for short values; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
