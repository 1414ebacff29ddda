"""Text metrics as columns, and the registry they live in.

A scoring pass canonicalises each text once, takes each kind of distance once, and derives
every requested metric from those columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text as X
from scorelake.functions.distance import ref_distances, unit_distances
from scorelake.session import spread

ANLS_THRESHOLD = 0.5
NUMBER = "^[+-]?(\\d+(_\\d+)*(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$|(?i)^[+-]?(inf|infinity|nan)$"


@dataclass(frozen=True)
class Metric:
    name: str
    worst: float
    value: Callable[[Column, Column], Column]
    uses: tuple[str, ...] = ()


_METRICS: dict[str, Metric] = {}


def register_metric(
    name: str, value: Callable[[Column, Column], Column], worst: float, uses: Sequence[str] = ()
) -> None:
    """``value(pred, refs)`` gives the metric's column; ``worst`` is what a failed sample
    gets. ``uses`` names shared stages (see ``_STAGES``) the expression reads by column."""
    _METRICS[name] = Metric(name, float(worst), value, tuple(uses))


def metric(name: str) -> Metric:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(_METRICS)}")
    return _METRICS[name]


def metric_names() -> list[str]:
    return sorted(_METRICS)


# --- shared stages: name -> (columns it needs first, its columns) -------------------------


def _each(fn):
    return lambda refs: F.transform(refs, fn)


_STAGES: dict[str, tuple[tuple[str, ...], Callable[[], dict[str, Column]]]] = {
    "p_canon": ((), lambda: {"_p_canon": X.canonical(F.col("_pred"))}),
    # Most right answers are copies of a reference: those are made canonical once.
    "canon": (("p_canon",), lambda: {
        "_r_canon": _each(lambda r: F.when(r == F.col("_pred"), F.col("_p_canon")).otherwise(X.canonical(r)))(F.col("_refs1"))}),
    "spaced": ((), lambda: {"_p_spaced": X.spaced(F.col("_pred"))}),
    "p_loose": (("spaced",), lambda: {
        "_p_loose": X.casefold(F.col("_p_spaced")),
        "_r_spaced": _each(lambda r: F.when(r == F.col("_pred"), F.col("_p_spaced")).otherwise(X.spaced(r)))(F.col("_refs1"))}),
    "loose": (("p_loose",), lambda: {
        "_r_loose": _each(lambda r: F.when(r == F.col("_p_spaced"), F.col("_p_loose")).otherwise(X.casefold(r)))(F.col("_r_spaced"))}),
    "lower": ((), lambda: {
        "_p_lower": X.collapse(F.lower("_pred")),
        "_r_lower": _each(lambda r: X.collapse(F.lower(r)))(F.col("_refs1"))}),
    "d_char": (("canon",), lambda: {
        "_d_char": ref_distances(F.col("_p_canon"), F.col("_r_canon"))}),
    "d_word": (("canon",), lambda: {
        "_d_word": ref_distances(F.col("_p_canon"), F.col("_r_canon"), " ")}),
    "d_unit": (("canon",), lambda: {
        "_d_unit": unit_distances(fold=False)(F.col("_p_canon"), F.col("_r_canon"))}),
    "d_fold": (("canon",), lambda: {
        "_d_fold": unit_distances(fold=True)(F.col("_p_canon"), F.col("_r_canon"))}),
    "d_loose": (("loose",), lambda: {
        "_d_loose": ref_distances(F.col("_p_loose"), F.col("_r_loose"), " ")}),
    "d_lower": (("lower",), lambda: {
        "_d_lower": ref_distances(F.col("_p_lower"), F.col("_r_lower"), reach=ANLS_THRESHOLD)}),
}


def _count(sep: str) -> Callable[[Column], Column]:
    if not sep:
        return F.length
    return lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, sep)))


def _error_rate(pred: str, refs: str, dist: str, sep: str = "") -> Column:
    """Lowest distance / reference length over the references; an empty reference is 0 for
    an empty prediction, else 1."""
    count = _count(sep)

    def rate(d, r):
        return F.when(count(r) == 0, F.when(F.col(pred) == "", 0.0).otherwise(1.0)).otherwise(d / count(r))

    return F.array_min(F.zip_with(dist, refs, rate))


def _accuracy(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - rate)


def _ned(_p, _r):
    def one(d, r):
        longest = F.greatest(F.length(r), F.length("_p_canon"))
        return F.when(longest == 0, 0.0).otherwise(d / longest)

    return F.array_min(F.zip_with("_d_char", "_r_canon", one))


def _length_ratio(pred, refs):
    first = F.length(F.element_at("_r_canon", 1))
    return F.when(first == 0, (F.length(pred) > 0).cast("double")).otherwise(F.length("_p_canon") / first)


def anls_value(pred: Column, refs: Column, dists: Column) -> Column:
    """Best similarity over the references, 0 below the threshold, which a reference without a distance is; ``refs``
    are collapsed lower-case texts."""
    def one(d, r):
        longest = F.greatest(F.length(r), F.length(pred))
        sim = F.when(longest == 0, 1.0).otherwise(1.0 - d / longest)
        return F.when(sim >= ANLS_THRESHOLD, sim).otherwise(0.0)

    return F.coalesce(F.array_max(F.zip_with(dists, refs, one)), F.lit(0.0))


def _to_number(c: Column) -> Column:
    plain = F.replace(F.regexp_replace(X.strip(c), "%+\\z", ""), F.lit(","), F.lit(""))
    plain = X.strip(plain)
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def relaxed_accuracy(pred: Column, refs: Column, tolerance: float = 0.05) -> Column:
    p = _to_number(pred)

    def hit(ref):
        r = _to_number(ref)
        near = F.when(r == 0, p == 0).otherwise(F.abs(p - r) / F.abs(r) <= tolerance)
        same = F.lower(X.strip(pred)) == F.lower(X.strip(ref))
        return F.when(p.isNotNull() & r.isNotNull(), near & ~F.isnan(p) & ~F.isnan(r)).otherwise(same)

    return F.exists(refs, hit).cast("double")


def _among(pred: str, refs: str) -> Callable[[Column, Column], Column]:
    return lambda _p, r: ((F.size(r) > 0) & F.array_contains(F.col(refs), F.col(pred))).cast("double")


def _contains(_p, refs):
    hit = F.exists("_r_loose", lambda r: (r != "") & F.contains(F.col("_p_loose"), r))
    return hit.cast("double")


def _anls(_p, refs):
    value = anls_value(F.col("_p_lower"), F.col("_r_lower"), F.col("_d_lower"))
    return F.when(F.size(refs) == 0, 0.0).otherwise(value)


def _unit_rate(kind: str = "unit") -> Column:
    found = F.col(f"_d_{kind}")

    def rate(d, n):
        return F.when(n == 0, F.when(found["size"] == 0, 0.0).otherwise(1.0)).otherwise(d / n)

    return F.array_min(F.zip_with(found["d"], found["n"], rate))


register_metric("cer", lambda p, r: _error_rate("_p_canon", "_r_canon", "_d_char"), 1, ["d_char"])
register_metric("wer", lambda p, r: _error_rate("_p_canon", "_r_canon", "_d_word", " "), 1, ["d_word"])
register_metric("acer", lambda p, r: _unit_rate(), 1, ["d_unit"])
register_metric("wer_loose", lambda p, r: _error_rate("_p_loose", "_r_loose", "_d_loose", " "), 1, ["d_loose"])
register_metric("ned", _ned, 1, ["d_char"])
register_metric("char_accuracy", lambda p, r: _accuracy(_error_rate("_p_canon", "_r_canon", "_d_char")), 0, ["d_char"])
register_metric("akshara_accuracy", lambda p, r: _accuracy(_unit_rate()), 0, ["d_unit"])
register_metric("akshara_accuracy_digitfold", lambda p, r: _accuracy(_unit_rate("fold")), 0, ["d_fold"])
register_metric("exact_match", _among("_p_canon", "_r_canon"), 0, ["canon"])
register_metric("loose_match", _among("_p_loose", "_r_loose"), 0, ["loose"])
register_metric("length_ratio", _length_ratio, 0, ["canon"])
register_metric("anls", _anls, 0, ["d_lower"])
register_metric("relaxed_accuracy", relaxed_accuracy, 0)
register_metric("contains_match", _contains, 0, ["loose"])


def score_texts(
    df: DataFrame,
    metrics: Sequence[str],
    pred: str = "output",
    refs: str = "references",
    ok: str | None = "ok",
    postprocess: bool = False,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """``df`` plus one column per metric. A failed sample (``ok`` false or no output) gets
    every metric's worst value, so failures never drop out of a mean.

    Comparing two texts costs far more than moving them, and cost follows text length, not
    rows or bytes: ``spread_by`` (the row's key) hashes the rows evenly over the session's
    shuffle partitions before any distance is taken."""
    wanted = [metric(m) for m in metrics]
    keep = df.columns
    if spread_by:
        df = spread(df, *spread_by)
    good = F.col(pred).isNotNull() if ok is None else F.coalesce(F.col(ok), F.lit(False)) & F.col(pred).isNotNull()
    text = X.clean_model_output(F.col(pred)) if postprocess else F.coalesce(F.col(pred), F.lit(""))
    empty = F.array().cast("array<string>")
    out = df.withColumns({"_good": good, "_pred": text, "_refs": F.coalesce(F.col(refs), empty)})
    out = out.withColumn("_refs1", F.when(F.size("_refs") > 0, F.col("_refs")).otherwise(F.array(F.lit(""))))
    done: set[str] = set()

    def build(stage: str) -> None:
        nonlocal out
        if stage in done:
            return
        first, columns = _STAGES[stage]
        for dep in first:
            build(dep)
        out = out.withColumns(columns())
        done.add(stage)

    for m in wanted:
        for stage in m.uses:
            build(stage)
    scored = {
        m.name: F.when(F.col("_good"), m.value(F.col("_pred"), F.col("_refs"))).otherwise(m.worst)
        for m in wanted
    }
    return out.select(*keep, *[c.alias(n) for n, c in scored.items()])


def melt_scores(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide scores to ``(keys, metric, value)``; a NULL value means "does not apply"."""
    cast = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*keys, *cast).unpivot(list(keys), list(metrics), "metric", "value")
