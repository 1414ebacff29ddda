"""Quality rules by weak supervision.

Each rule of ``RULES`` votes good (1) or bad (0) on a text or abstains. No vote decides alone: an
expectation-maximisation over all documents estimates, without labels, how often texts are good and
how reliable each rule is on good and on bad texts; a text's posterior probability of being good,
given its votes, replaces all-must-pass filtering. Documents with equal votes share a posterior, so
the fit needs only the count of each vote pattern: at most 3 ** len(RULES) rows whatever the corpus.

The base figures of ``FEATURES`` are exact counts over the whole text. Null and empty texts have no
words and fail the base test. Rows are scored one by one: ties, repeated rows and null ids change
nothing, other columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import frugal, materialise, pieces
from scorelake.llm.words import SPACE, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 upper case, 3 lower case or beyond ASCII, 4 digit, 5 exclamation mark
_KIND[list(SYMBOLS)] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[192:] = 3
_KIND[48:58] = 4
_KIND[33] = 5

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("n_upper", "n_letters", "n_marks", "n_distinct", "n_lines", "n_sentences", "n_odd_words")

def repeat_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    runs = windows(hashes, 3)
    if len(runs) < 2:
        return 0
    order = np.sort(runs)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(runs, again))
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def odd_words(raw: np.ndarray, symbols: int) -> int:
    """Words that hold a symbol."""
    if not symbols:
        return 0
    word = ~SPACE[raw]
    starts = np.flatnonzero(word & np.append(True, ~word[:-1]))
    return len(np.unique(np.searchsorted(starts, np.flatnonzero(_KIND[raw] == 1), side="right")))


def measure(texts: list[bytes]) -> list[tuple[int, ...]]:
    """FEATURES and SHAPES of each text."""
    out = []
    for text, hashes in zip(texts, word_hashes(texts), strict=True):
        raw = np.frombuffer(text, np.uint8)
        kinds = np.bincount(_KIND[raw], minlength=6)
        chars = int(((raw & 0xC0) != 0x80).sum() - SPACE[raw].sum())
        again, lines = duplicate_lines(text)
        ends = int(((raw == 46) | (raw == 63)).sum())
        out.append((len(hashes), chars, int(kinds[1]), again, repeat_words(hashes), int(kinds[2]), int(kinds[2] + kinds[3]),
                    int(kinds[5]), len(np.unique(hashes)), lines, ends, odd_words(raw, kinds[1])))
    return out


def _measure(at: int, schema: pa.Schema):
    """Append the figures of column ``at`` to every row."""
    kind = schema.field(len(schema) - 1).type

    def measured_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, whole.schema.field(at).name, 1 << 20):
                texts = [b"" if t is None else t.encode() for t in batch.column(at).to_pylist()]
                figures = np.array(measure(texts), np.int64).reshape(len(texts), len(kind))
                added = pa.StructArray.from_arrays([pa.array(figures[:, k]) for k in range(len(kind))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, added], names=schema.names)

    return measured_batch


def measured(docs: DataFrame, name: str = "figures") -> DataFrame:
    """All columns of every row, and FEATURES and SHAPES of its text as the struct ``name``."""
    if name in docs.columns:
        raise ValueError(f"choose another name than {name!r} for the figures")
    fields = T.StructType([T.StructField(c, T.LongType()) for c in FEATURES + SHAPES])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, fields)])
    figures = pa.struct([(c, pa.int64()) for c in FEATURES + SHAPES])
    layout = pa.schema([*((c, pa.null()) for c in docs.columns), (name, figures)])
    return docs.mapInArrow(frugal(_measure(docs.columns.index("text"), layout)), schema)


def _share(part: str, whole: str):
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad, good):
    """0 where ``bad`` holds, else 1 where ``good`` holds, else 2 for an abstention."""
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(2))


#: name -> vote; a text without words gets an abstention from the rules that need some.
RULES = {
    "symbols": lambda: _vote(F.col("n_symbols") > 0.2 * F.col("n_words"), F.col("n_symbols") <= 0.02 * F.col("n_words")),
    "marks": lambda: _vote(F.col("n_marks") > 0.1 * F.col("n_words"), F.col("n_marks") <= 0.02 * F.col("n_words")),
    "upper": lambda: _vote(_share("n_upper", "n_letters") > 0.3, (_share("n_upper", "n_letters") < 0.1) & (F.col("n_letters") > 0)),
    "repeats": lambda: _vote(_share("n_repeat_words", "n_words") > 0.35, (_share("n_repeat_words", "n_words") < 0.1) & (F.col("n_words") >= 20)),
    "lines": lambda: _vote((_share("n_dup_lines", "n_lines") > 0.3) & (F.col("n_lines") > 2), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
    "variety": lambda: _vote((_share("n_distinct", "n_words") < 0.12) & (F.col("n_words") >= 50), (_share("n_distinct", "n_words") > 0.3) & (F.col("n_words") >= 50)),
    "length": lambda: _vote((_share("word_chars", "n_words") > 12) | ((_share("word_chars", "n_words") < 2.5) & (F.col("n_words") > 0)), _share("word_chars", "n_words").between(3.5, 9)),
    "letters": lambda: _vote(_share("n_letters", "word_chars") < 0.9, _share("n_letters", "word_chars") > 0.93),
    "odd_words": lambda: _vote(_share("n_odd_words", "n_words") > 0.2, _share("n_odd_words", "n_words") < 0.05),
    "sentences": lambda: _vote((_share("n_sentences", "n_words") < 0.01) & (F.col("n_words") >= 100), _share("n_sentences", "n_words").between(0.03, 0.3)),
}


def pattern():
    """All votes as one number, base 3."""
    total = F.lit(0)
    for k, vote in enumerate(RULES.values()):
        total = total + vote() * F.lit(3 ** k)
    return total


def votes(number: int) -> list[int]:
    return [number // 3 ** k % 3 for k in range(len(RULES))]


def fit(counts: dict[int, int], rounds: int = 200, prior: float = 0.8, strength: float = 2.0) -> dict[int, float]:
    """The posterior of each vote pattern. Two latent classes; a rule's votes are independent given
    the class. It starts from rules that seldom accuse a good text (2 %) while each bad text is bad in its
    own way and accused by a third of them, and from a share ``prior`` of good texts; ``strength`` pseudo-counts of that start keep a rule that hardly ever votes in place."""
    table = np.array([votes(p) for p in counts]).reshape(len(counts), len(RULES))
    weight = np.array([float(n) for n in counts.values()])
    start = np.empty((len(RULES), 2, 3))  # rule, class (bad, good), vote (bad, good, abstain)
    start[:, 0], start[:, 1] = (0.3, 0.5, 0.2), (0.02, 0.8, 0.18)
    chance, share = start.copy(), prior

    def posterior() -> np.ndarray:
        logs = np.log([1 - share, share]) + sum(np.log(chance[k][:, table[:, k]]).T for k in range(len(RULES)))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    last = -math.inf
    for _ in range(rounds if len(weight) else 0):
        good = posterior()
        both = np.stack([(1 - good) * weight, good * weight])
        share = float(np.clip((both[1].sum() + strength * prior) / (weight.sum() + strength), 1e-6, 1 - 1e-6))
        for k in range(len(RULES)):
            seen = np.stack([np.bincount(table[:, k], both[c], 3) for c in range(2)])
            chance[k] = (seen + strength * start[k]) / (seen.sum(1, keepdims=True) + strength)
        if abs(share - last) < 1e-9:
            break
        last = share
    return dict(zip(counts, posterior().tolist() if len(weight) else [], strict=True))


def known_posteriors(seen: DataFrame) -> DataFrame:
    """(pattern, posterior) of every vote pattern: at most 3 ** len(RULES) rows. The fit weighs a pattern
    by its rows that pass the base test, so the latent bad class is what that test lets through."""
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count_if(~base_failed()).alias("n")).orderBy("pattern").collect()}
    return seen.sparkSession.createDataFrame(list(fit(counts).items()), "pattern int, posterior double")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rated(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, FEATURES, SHAPES, base_failed, posterior and kept of every row. The texts are read once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialise(measured(texts).select("doc_id", "figures.*").withColumn("pattern", pattern()))
    out = seen.join(F.broadcast(known_posteriors(seen)), "pattern", "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: one pass for the fit, one for the choice,
    and no shuffle of texts."""
    known = known_posteriors(measured(docs.select("text")).select("figures.*").select("n_words", "n_repeat_words", pattern().alias("pattern")))
    name = "__figures"
    row = measured(docs, name)
    judged = row.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), f"{name}.*").withColumn("pattern", pattern())
    kept = judged.join(F.broadcast(known), "pattern").where(~base_failed() & (F.col("posterior") >= least))
    return kept.select("row.*")
