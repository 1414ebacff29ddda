"""Golden rows and differential tests of text functions and metrics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scorelake.functions import distance, names
from scorelake.functions import text as X
from scorelake.functions.metrics import metric, metric_names, register_metric, score_texts
from scorelake.plans.evaluation import BenchmarkSpec, evaluate


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("v")).head().v


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_bit_distance_equals_table():
    rng = random.Random(2)
    for n in (3, 14, 90):
        for _ in range(200 if n < 90 else 30):
            a, b = ("".join(rng.choice("abcक") for _ in range(rng.randint(0, n))) for _ in range(2))
            assert distance.bit_distance(a, b) == plain_distance(a, b), (a, b)
            assert distance.bit_distance(a.split("a"), b.split("a")) == plain_distance(a.split("a"), b.split("a"))


def test_edit_distance_short_and_long(spark):
    rng = random.Random(4)
    rows = [tuple("".join(rng.choice("abkक😀 ") for _ in range(n)) for _ in range(2)) for n in (0, 1, 9, 150, 260, 400)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", distance.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain_distance(r.a, r.b) for r in got)


@pytest.mark.parametrize("raw,want", [
    ("a   b\t\n", "a b"), (" \x1c\x1fx ", "x"), ("é", "é"), ("ऩ़", "ऩ़"), ("", "")])
def test_canonical(spark, raw, want):
    assert one(spark, raw, X.canonical) == want


@pytest.mark.parametrize("raw,want", [
    ("Straße, OK!", "strasse ok"), ("ल्यायो।", "ल्यायो"), ("a‍b—c", "ab c"), ("  ॥ ", "")])
def test_loose(spark, raw, want):
    assert one(spark, raw, X.loose) == want


@pytest.mark.parametrize("raw,want", [
    ("<think>x\ny</think> 42 ", "42"), ("7 <THINK> cut off", "7"), ("hidden</think>8", "8"), ("```json\n{}\n```", "{}"),
    ("see ```a``` b", "see ```a``` b"), ("done<|endoftext|>", "done"), (None, "")])
def test_clean_model_output(spark, raw, want):
    assert one(spark, raw, X.clean_model_output) == want


@pytest.mark.parametrize("raw,want", [
    ("विद्यालय", ["वि", "द्या", "ल", "य"]), ("क्‍ष a१।", ["क्ष", " ", "a", "१", "।"]), ("अं ओं", ["अं", " ", "ओं"]), ("", [])])
def test_aksharas(spark, raw, want):
    assert one(spark, raw, X.aksharas) == want


@pytest.mark.parametrize("raw,want", [
    ("Vendor/Model_X (High):free", ["model-x-high", "model-x"]), ("m-no-thinking", ["m-no-thinking", "m-no"]),
    ("a-2025-04-16-max-20250514", ["a-2025-04-16-max-20250514", "a-2025-04-16", "a"]), ("plain-2506", ["plain-2506"])])
def test_candidates(spark, raw, want):
    assert one(spark, raw, names.candidates) == want


@pytest.mark.parametrize("raw,want", [
    ("2025-09-17", "2025-09-17 00:00:00"), ("20250917101112", "2025-09-17 10:11:12"), ("2025/09/17", "2025-09-17 00:00:00"),
    ("2025-09-17T01:00:00+05:00", "2025-09-16 20:00:00"), ("someday", None)])
def test_parse_date(spark, raw, want):
    assert one(spark, raw, lambda c: F.date_format(names.parse_date(c), "yyyy-MM-dd HH:mm:ss")) == want


def test_error_kinds_and_slug(spark):
    assert one(spark, "HTTP 503: busy 12: x", names.error_kind) == "HTTP N: busy N"
    assert one(spark, "Timeout: 3 s", names.error_kind) == "Timeout"
    assert one(spark, " Qwen3-VL 8B (β)/x. ", names.slug) == "qwen3-vl-8b-x"


GOLDEN = [
    ("cer", "abc", ["abc"], 0), ("cer", "abd", ["abc"], 1 / 3), ("cer", "", ["abc"], 1), ("cer", "abcdef", ["abc"], 1),
    ("cer", "x", [""], 1), ("cer", "", [""], 0), ("cer", "x", [], 1), ("cer", "", [], 0), ("cer", "abd", ["zzz", "abc"], 1 / 3),
    ("acer", "कताब", ["किताब"], 1 / 3), ("acer", "विदयालय", ["विद्यालय"], 1 / 2),
    ("wer", "नेपाल सरकारले बजेट ल्यायो", ["नेपाल सरकारले बजेट ल्यायो।"], 0.25), ("wer_loose", "नेपाल सरकारले बजेट ल्यायो", ["नेपाल सरकारले बजेट ल्यायो।"], 0),
    ("ned", "abcd", ["ab"], 0.5), ("ned", "", [""], 0), ("char_accuracy", "abcabcabc", ["abc"], 0),
    ("anls", "Paris", ["paris"], 1), ("anls", "Pariss", ["paris"], 5 / 6), ("anls", "London", ["paris"], 0), ("anls", "x", [], 0),
    ("relaxed_accuracy", "104", ["100"], 1), ("relaxed_accuracy", "106", ["100"], 0), ("relaxed_accuracy", "12%", ["12"], 1),
    ("relaxed_accuracy", "1,000", ["1000"], 1), ("relaxed_accuracy", "Yes", ["yes"], 1), ("relaxed_accuracy", "0", ["0"], 1),
    ("relaxed_accuracy", "1d", ["1"], 0), ("relaxed_accuracy", "nan", ["nan"], 0), ("relaxed_accuracy", "0.1", ["0"], 0),
    ("contains_match", "The answer is Kathmandu.", ["kathmandu"], 1), ("contains_match", "Pokhara", ["kathmandu"], 0), ("contains_match", "x", ["!"], 0),
    ("akshara_accuracy_digitfold", "42", ["४२"], 1), ("akshara_accuracy_digitfold", "43", ["४२"], 0.5), ("akshara_accuracy", "42", ["४२"], 0),
    ("exact_match", " a  b", ["a b"], 1), ("exact_match", "", [], 0), ("loose_match", "A, b!", ["a b"], 1), ("length_ratio", "ab", ["abcd", "x"], 0.5), ("length_ratio", " ", [""], 1),
]


def test_golden_metrics(spark):
    wanted = sorted({g[0] for g in GOLDEN})
    rows = [(i, p, r) for i, (_, p, r, _v) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, output string, references array<string>")
    got = {r.i: r for r in score_texts(df, wanted, ok=None).collect()}
    for i, (name, p, r, v) in enumerate(GOLDEN):
        assert got[i][name] == pytest.approx(v), (name, p, r)


def test_failed_samples_get_the_worst_value(spark):
    df = spark.createDataFrame([(False, "abc", ["abc"]), (True, None, ["abc"])], "ok boolean, output string, references array<string>")
    for row in score_texts(df, metric_names()).collect():
        assert all(row[m] == metric(m).worst for m in metric_names())


def test_register_metric(spark):
    register_metric("starts", lambda p, refs: F.exists(refs, lambda r: F.startswith(p, r)).cast("double"), worst=0)
    df = spark.createDataFrame([("abc", ["ab"])], "output string, references array<string>")
    assert score_texts(df, ["starts"], ok=None).head().starts == 1.0
    with pytest.raises(KeyError):
        metric("nope")
    from scorelake.functions import metrics
    del metrics._METRICS["starts"]


def test_short_value_functions_use_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(distance.similarity(F.col("a"), F.col("b")), X.loose(F.col("a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_short_unit_distances_equal_long_ones(spark, monkeypatch):
    """Sequences compared through signs in the JVM, and by the bit-parallel form."""
    rng = random.Random(21)
    words = lambda: " ".join(rng.choice(["a", "b", "cc", "é", "x.*", "<", ">"]) for _ in range(rng.randint(0, 12)))
    rows = [(i, words(), [words() for _ in range(rng.randint(1, 3))]) for i in range(150)] + [(900, "", [""]), (901, "a", [""]), (902, "a b", [None, "b"]), (903, " ".join(map(str, range(195))), [" ".join(map(str, range(3, 200)))])]
    df = spark.createDataFrame(rows, "i int, p string, r array<string>")
    near = {r.i: r.d for r in df.select("i", distance.ref_distances(F.col("p"), F.col("r"), " ").alias("d")).collect()}
    monkeypatch.setattr(distance, "SHORT_CELLS", -1)
    far = {r.i: r.d for r in df.select("i", distance.ref_distances(F.col("p"), F.col("r"), " ").alias("d")).collect()}
    assert near == far and near[903] == [8] and near[902] == [None, 1]


def test_lengths_out_of_reach_are_not_compared(spark):
    df = spark.createDataFrame([("abcd", ["ab", "a", "abcdefgh", "abcdefghi", None, "abcd"]), ("", ["", "a"])], "p string, r array<string>")
    got = [r.d for r in df.select(distance.ref_distances(F.col("p"), F.col("r"), reach=0.5).alias("d")).collect()]
    assert got == [[2, None, 4, None, None, 0], [0, None]]


def test_bit_distance_of_long_sequences(monkeypatch):
    """Replacements and omissions are settled without a table; mixed edits by bands of it, as all rows give."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh क😀") for _ in range(1500))
    mixed = "".join(rng.choice(("", c, c, c, c, c, c, c, "x" + c)) for c in text)
    assert distance.bit_distance(text, mixed) == distance.bit_distance(mixed, text) == plain_distance(text, mixed)
    assert distance.bit_distance(text.split("a"), mixed.split("a")) == plain_distance(text.split("a"), mixed.split("a"))
    other = "".join(rng.sample(text, len(text)))
    assert distance.bit_distance(text, other) == plain_distance(text, other)
    monkeypatch.delattr(distance, "_within")
    assert distance.bit_distance(text, text.replace("e", "¤")) == text.count("e")
    assert distance.bit_distance(text.replace("c", ""), text) == text.count("c")
    assert distance.bit_distance(text.split(), [w.replace("e", "¤") for w in text.split()]) == sum("e" in w for w in text.split())


def test_aksharas_of_whole_texts_are_those_of_the_pattern():
    rng = random.Random(21)
    pattern, gone = re.compile(X.AKSHARA), str.maketrans("", "", X.ZERO_WIDTH)
    for _ in range(3000):
        t = "".join(rng.choice("कखग़ऩ़़््ािॉअआॐ१ a,‍😀ठथ॑ंxक़\n") for _ in range(rng.randint(0, 14)))
        units = pattern.findall(t.translate(gone))
        assert X.joined_aksharas(t) == "\x1f".join(units)
        assert X.joined_aksharas(t, fold=True) == "\x1f".join(units).translate(str.maketrans(X.DEVANAGARI_DIGITS, X.LATIN_DIGITS))


def test_spaces_are_the_listed_ones(spark):
    signs = spark.range(1, 0x11000).filter("id < 55296 OR id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("s"))
    listed, looked = F.col("s").rlike(f"^{X.WHITESPACE}$"), F.col("s").rlike(f"(?U)^{X.SPACES}$")
    assert signs.filter(listed != looked).count() == 0 and signs.filter(looked).count() == 29


def test_syllables_cross_to_python_once(spark):
    """As joined texts they cost the JVM more than the distances, and four times the bytes, both ways."""
    rows = spark.createDataFrame([(1, "कि १ख", ["कि 1ख", None, ""]), (2, "", ["‍"]), (3, "‍", [""]), (4, "क", [])], "i int, output string, references array<string>")
    out = score_texts(rows, ["acer", "akshara_accuracy", "akshara_accuracy_digitfold"], ok=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan.lower()
    got = {r.i: (r.acer, r.akshara_accuracy, r.akshara_accuracy_digitfold) for r in out.collect()}
    assert got == {1: (pytest.approx(0.25), 0.75, 1.0), 2: (0.0, 1.0, 1.0), 3: (0.0, 1.0, 1.0), 4: (1.0, 0.0, 0.0)}


def test_scored_rows_are_written_without_references(spark):
    log = spark.createDataFrame([("a", "1", 0, True, "x", ["x"]), ("a", "2", 0, True, "y", ["z"])], "run_key string, sample_id string, seq int, ok boolean, output string, references array<string>")
    results, scored = evaluate(BenchmarkSpec("t", "exact_match", ("exact_match",), postprocess=False), log, replicates=10)
    assert "references" not in scored.columns and results.head().metrics["exact_match"].value == 0.5


def test_loose_text_is_made_in_one_pass(spark):
    """As by collapsing spaces, dropping punctuation and collapsing again, for every sign and for mixed runs of them."""
    rng = random.Random(5)
    odd = " \t\n\x0b\x1c\x1f\x85\xa0   　.,-_!?।॥॰​‌﻿⁠aBßİİΣé́क$+<"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(400)] + [f"A{chr(i)}b{chr(i)} {chr(i)}" for i in range(0x3100) if not 0xD800 <= i < 0xE000] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spaced = F.regexp_replace(X.strip_zero_width(X.canonical(F.col("t"))), X.PUNCTUATION, " ")
    assert df.filter(~X.loose(F.col("t")).eqNullSafe(X.casefold(X.collapse(spaced)))).collect() == []
    assert str(X.spaced(F.col("t"))._jc).count("regexp_replace") == 1
    # Each side of a scored pair is made once, not once for every mention of it.
    pairs = df.select(F.col("t").alias("output"), F.array(F.lit("x"), F.upper("t"), "t").alias("references"))
    scored = score_texts(pairs, ["loose_match", "wer_loose"], ok=None)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("(?U)[") == 2
    assert scored.filter((F.col("output").isNotNull()) & (F.col("loose_match") < 1)).collect() == []
