"""Golden rows of the structured scorers, each scorer run once over all its cases."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from scorelake import session
from scorelake.operators import kv, layout, matching, qa, reading_order, table_distance, tables
from scorelake.operators.ordered import count_inversions

GOLD = {"policy": "A-1904", "holder": "Mira Okafor", "insured": ["roof", "garden wall"]}  # four pairs
BERTH = {"vessel": "Tern", "berth": ["Pier 4, North Quay", "Bergen"]}


def boxed(value, depth, key="data"):
    for _ in range(depth):
        value = {key: value}
    return value


KV_CASES = {
    "fenced": (GOLD, "Here:\n```json\n" + json.dumps({**GOLD, "holder": " Mira  Okafor"}) + "\n```", dict(kv_f1=1, kv_doc_exact=1, kv_parse_ok=1, kv_value_sim=1, kv_f1_digitfold=1)),
    "one_string": (GOLD, json.dumps({"insured": "roof, garden wall"}), dict(kv_recall=0.5, kv_precision=1)),
    "one_string_more": (GOLD, json.dumps({"insured": "roof, garden wall, shed"}), dict(kv_recall=0.5, kv_precision=2 / 3)),
    # policy: one sign of six differs
    "half": (GOLD, json.dumps({"policy": "A-1905", "holder": "Mira Okafor", "agent": "-"}), dict(kv_precision=1 / 3, kv_recall=1 / 4, kv_value_sim=(5 / 6 + 1) / 4, kv_doc_exact=0)),
    "other_digits": ({"year": "२०१९"}, '{"year": "2019"}', dict(kv_f1=0, kv_f1_digitfold=1)),
    "refusal": (GOLD, "The scan is too dark.", dict(kv_parse_ok=0, kv_f1=0)),
    "pairs": (GOLD, json.dumps([{"key": "holder", "value": "Mira Okafor"}, {"title": "x"}, 7]), dict(kv_precision=1, kv_recall=0.25)),
    "wrapped": (GOLD, json.dumps({"Result": {"output": {k.upper(): v for k, v in GOLD.items()}}}), dict(kv_f1=1)),
    "wrapped_deep": (GOLD, json.dumps(boxed(GOLD, 30)), dict(kv_f1=1)),
    "key_twice": (GOLD, '{"holder": "someone", "holder": "Mira Okafor"}', dict(kv_parse_ok=1, kv_precision=1, kv_recall=0.25)),
    "commas_inside": (BERTH, json.dumps({"vessel": "Tern", "berth": "Pier 4, North Quay, Bergen"}), dict(kv_f1=1)),
    "lines_inside": (BERTH, json.dumps({"vessel": "Tern", "berth": "Pier 4,North Quay\nBergen"}), dict(kv_f1=1)),
    "kinds": ({"count": "8", "open": "False", "share": "0.5"}, '{"count": 8, "open": false, "share": 0.5, "gap": null, "pad": " "} as asked }', dict(kv_f1=1)),
    "nothing": ({}, "{}", dict(kv_f1=1, kv_recall=1, kv_precision=0, kv_doc_exact=1)),
    "nothing_asked": ({}, '{"extra": 5}', dict(kv_f1=0, kv_doc_exact=0)),
    "endless_string": (GOLD, '"' + "v" * 1_000_000 + '"', dict(kv_parse_ok=1, kv_f1=0)),
    "escapes": (GOLD, '"' + '\\"' * 100_000 + '"', dict(kv_parse_ok=1, kv_f1=0)),
}


def check(rows, cases):
    got = {r["sample_id"]: r for r in rows}
    assert set(got) == set(cases)
    for name, case in cases.items():
        for m, v in case[-1].items():
            assert got[name][m] == (None if v is None else pytest.approx(v)), (name, m, got[name])


def test_kv(spark):
    fields = [(n, k, v) for n, (g, *_) in KV_CASES.items() for k, vs in g.items() for v in (vs if isinstance(vs, list) else [vs])]
    samples = [(n, True, c[1]) for n, c in KV_CASES.items()] + [("failed", False, None)]
    out = kv.score_kv(spark.createDataFrame(samples, "sample_id string, ok boolean, output string"),
                      spark.createDataFrame(fields, "sample_id string, key string, value string"))
    check(out.collect(), {**KV_CASES, "failed": (kv.WORST,)})


QA_CASES = {
    "right": ("19 May", ["19 May"], True, dict(qa_score=1, abstention_accuracy=None, false_abstention=0)),
    "made_up": ("Lisbon", [], False, dict(qa_score=0, abstention_accuracy=0, abstained_loose=0, anls_answerable=None)),
    "asked_words": ("Answer, not present!", [], False, dict(qa_score=1, abstained_loose=1)),
    "own_words": ("That date is not mentioned anywhere.", [], False, dict(qa_score=0, abstained_loose=1)),
    "inside_a_word": ("knot foundry, misgiven", [], False, dict(abstained_loose=0)),
    "gave_up": ("ANSWER NOT PRESENT", ["19 May"], True, dict(qa_score=0, false_abstention=1, qa_score_digitfold=0)),
    "other_digits": ("१९", ["19"], True, dict(qa_score=0, qa_score_digitfold=1)),
    "one_off": ("harbor", ["quay", "harbour"], True, dict(qa_score=6 / 7)),
}


def test_qa(spark):
    rows = [(n, True, *c[:3]) for n, c in QA_CASES.items()] + [("failed", False, None, ["a"], True)]
    out = qa.score_qa(spark.createDataFrame(rows, "sample_id string, ok boolean, output string, references array<string>, answerable boolean"))
    check(out.collect(), {**QA_CASES, "failed": (dict(qa_score=0, qa_score_digitfold=0, anls_answerable=None),)})


BLOCKS = ["Harbour notice", "Tide tables for spring", "Contact the pilot office", "Signed: port captain"]
ORDER_CASES = {
    "in_order": (BLOCKS, "\n".join(BLOCKS), dict(reading_order=1, cer=0, char_accuracy=1, block_recall=1)),
    "backwards": (BLOCKS, "\n".join(BLOCKS[::-1]), dict(reading_order=0, block_recall=1)),
    "one_read": (BLOCKS, BLOCKS[2], dict(reading_order=None, block_recall=0.25)),
    # "Dues 75" fits both dues; each block still finds its own line
    "misread": (["Dues: 750 crowns", "Dues: 980 crowns", "Receipt"], "Dues 75 crowns\nDues: 980 crowns\nReceipt", dict(reading_order=1, block_recall=1)),
    "same_twice": (["same row", "same row", "last row"], "same row\nlast row\nsame row", dict(reading_order=2 / 3, block_recall=1)),
    "other_digits": (["Bay ४२"], "Bay 42", dict(akshara_accuracy_digitfold=1, akshara_accuracy=4 / 6)),
    "blank": ([" "], "x", dict(cer=1, block_recall=1, reading_order=None)),
}


def test_reading_order(spark):
    rows = [(n, True, c[1], c[0]) for n, c in ORDER_CASES.items()] + [("failed", False, None, BLOCKS)]
    out = reading_order.score_reading_order(spark.createDataFrame(rows, "sample_id string, ok boolean, output string, blocks array<string>"))
    check(out.collect(), {**ORDER_CASES, "failed": (reading_order.WORST,)})


FIGURE, CAPTION = ("figure", [0.2, 0.1, 0.6, 0.3]), ("caption", [0.2, 0.35, 0.6, 0.4])
PAIR, ALONE = [FIGURE, CAPTION], [("figure", [0.25, 0.1, 0.75, 0.3])]
INF = float("inf")
LAYOUT_CASES = {
    "exact": (PAIR, [{"role": " Figure", "bbox": [200, 100, 600, 300]}, {"role": "caption", "bbox": [200, 350, 600, 400]}], None, dict(layout_f1=1, detection_f1=1)),
    "wrong_role": (PAIR, [{"type": "figure", "box": [200, "100", 600, 300]}, {"role": "footer", "bbox": [200, 350, 600, 400]}], None, dict(layout_f1=0.5, detection_f1=1)),
    "elsewhere": (PAIR, [{"role": "caption", "bbox": [200, 700, 600, 750]}], None, dict(layout_f1=0, layout_parse_ok=1)),
    "no_regions": (PAIR, {}, None, dict(layout_recall=0, layout_f1=0)),
    # Both predictions lie over the figure; the better one takes it, the other stays alone.
    "compete": (ALONE, [{"role": "figure", "bbox": [250, 120, 750, 300]}, {"role": "figure", "bbox": [250, 100, 750, 300]}], None, dict(layout_precision=0.5, layout_recall=1, layout_f1=2 / 3)),
    "rows_first": (ALONE, {"regions": [{"label": "figure", "box_2d": [100, 250, 300, 750]}]}, None, dict(layout_f1=1)),
    "fractions": (ALONE, {"elements": [{"role": "figure", "bbox": [0.75, 0.1, 0.25, 0.3]}]}, None, dict(layout_f1=1)),
    "pixels": (ALONE, [{"role": "figure", "bbox": [400, 200, 1200, 600]}], [1600.0, 2000.0], dict(layout_f1=1)),
    "endless": (ALONE, [{"role": "figure", "bbox": ["0", "0", "inf", "inf"]}, {"role": "figure", "bbox": ["nan", 0, 1, 1]}, {"role": "figure", "bbox": [250, 100, 750, 300]}], None, dict(layout_f1=1)),
    "unreadable": (ALONE, [{"role": "figure", "bbox": [5]}, {"role": "figure"}, "x", {"role": "figure", "bbox": [1, 2, "c", 4]}], None, dict(layout_precision=0, layout_recall=0)),
    "both_empty": ([], [], None, dict(layout_f1=1, detection_f1=1, layout_recall=1)),
}


def test_layout(spark):
    rows = [(n, True, json.dumps(c[1]), c[2]) for n, c in LAYOUT_CASES.items()] + [("failed", False, None, None)]
    regions = [(n, i, r, b) for n, c in LAYOUT_CASES.items() for i, (r, b) in enumerate(c[0])]
    out = layout.score_layout(spark.createDataFrame(rows, "sample_id string, ok boolean, output string, size array<double>"),
                              spark.createDataFrame(regions, "sample_id string, gi int, role string, box array<double>"))
    check(out.collect(), {**LAYOUT_CASES, "failed": (layout.WORST,)})


def test_iou(spark):
    row = spark.range(1).select(matching.iou(F.array(*map(F.lit, (0.0, 0.0, 4.0, 2.0))), F.array(*map(F.lit, (2.0, 0.0, 6.0, 2.0)))).alias("v")).head()
    assert row.v == pytest.approx(1 / 3)  # 4 of 12


def greedy(pairs):
    used_l, used_r, out = set(), set(), set()
    for w, left, right in sorted(pairs, reverse=True):
        if left not in used_l and right not in used_r:
            used_l.add(left), used_r.add(right), out.add((left, right))
    return out


@pytest.mark.parametrize("small", [1024, 5])
def test_greedy_match_equals_sorted_pass(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL_GROUP", small)
    rng = random.Random(3)
    groups = {g: [(rng.randint(5, 9) / 10, a, b) for a in range(6) for b in range(6) if rng.random() < 0.6] for g in range(12)}
    rows = [(g, *p) for g, ps in groups.items() for p in ps]
    out = matching.greedy_match(spark.createDataFrame(rows, "g int, w double, l int, r int"), ["g"], "l", "r", "w")
    got = {}
    for r in out.collect():
        got.setdefault(r.g, set()).add((r.l, r.r))
    assert got == {g: greedy(ps) for g, ps in groups.items()}


def test_matching_equals_brute_force(spark):
    rng = random.Random(5)

    def box():
        x, y = rng.uniform(-1, 1), rng.uniform(0, 1)
        return [x, y, x + rng.choice([0, 0.1, 0.3]) + rng.random() * 0.05, y + rng.choice([0.02, 0.2])]

    def plain(a, b):
        side = lambda k: max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
        inter = side(0) * side(1)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    gold = [(s, i, box()) for s in range(6) for i in range(25)]
    pred = [(s, i, [v + rng.uniform(-0.01, 0.01) for v in b] if rng.random() < 0.7 else b) for s, i, b in gold for _ in range(1)]
    pred = [(s, i, [min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])]) for s, i, b in pred]
    out = matching.match_boxes(spark.createDataFrame(gold, "s int, gi int, box array<double>"),
                               spark.createDataFrame(pred, "s int, pi int, box array<double>"), ["s"], "gi", "pi")
    got = {(r.s, r.gi, r.pi) for r in out.collect()}
    want = set()
    for s in range(6):
        pairs = [(plain(g, p), gi, pi) for s1, gi, g in gold if s1 == s for s2, pi, p in pred if s2 == s]
        want |= {(s, *m) for m in greedy([x for x in pairs if x[0] >= 0.5])}
    assert got == want


def test_inversions(spark):
    rng = random.Random(1)
    orders = {g: rng.sample(range(40), n) for g, n in enumerate((1, 2, 5, 17, 40))}
    rows = [(g, i, p) for g, ps in orders.items() for i, p in enumerate(ps)]
    got = {r.g: r.inversions for r in count_inversions(spark.createDataFrame(rows, "g int, i int, p int"), ["g"], "i", "p").collect()}
    assert got == {g: sum(a > b for k, a in enumerate(ps) for b in ps[k + 1:]) for g, ps in orders.items()}


# A heading over three cells: seven nodes with the rows and the table.
CELLS = [(0, 0, 1, 3, "Ports"), (1, 0, 1, 1, "Oslo"), (1, 1, 1, 1, "ice"), (1, 2, 1, 1, "fog & rain")]
HEAD, BODY = '<tr><td colspan="3">Ports</td></tr>', "<tr><td>Oslo</td><td>ice</td><td>fog &amp; rain</td></tr>"
HTML = f"<table>{HEAD}{BODY}</table>"
GRID = [(0, 0, 1, 1, "day"), (0, 1, 1, 1, "tide"), (1, 0, 1, 1, "७"), (1, 1, 1, 1, "high")]  # seven nodes too
TABLE_CASES = {
    "equal": (CELLS, HTML, dict(teds=1, teds_struct=1, table_parse_ok=1, teds_digitfold=1)),
    "unclosed": (CELLS, "See <b>below</b>\n<TABLE border=1><TR><TH ColSpan='3'>\n Ports <tr><td>Oslo<td>ice<td>fog&nbsp;&#38;<br/>rain", dict(teds=1)),
    "body_gone": (CELLS, f"<table>{HEAD}</table>", dict(teds=1 - 4 / 7, teds_struct=1 - 4 / 7)),
    "other_text": (CELLS, HTML.replace("ice", "sun"), dict(teds=1 - 1 / 7, teds_struct=1)),  # three letters, none shared
    "no_span": (CELLS, HTML.replace(' colspan="3"', ""), dict(teds=1 - 1 / 7, teds_struct=1 - 1 / 7)),
    "empty_row": (CELLS, HTML.replace("</table>", "<tr></tr></table>"), dict(teds=1 - 1 / 8, teds_struct=1 - 1 / 8)),
    "bars": (GRID, "Tides:\n| day | tide |\n| :-- | ---: |\n| ७ | high |", dict(teds=1)),
    "bars_folded": (GRID, "|day|tide|\n|7|high|", dict(teds=1 - 1 / 7, teds_digitfold=1)),
    "inner": ([(0, 0, 1, 1, "left midright")], "<table><td>left<table><tr><th>mid</th></tr></table>right</td></table>", dict(teds=1)),
    "hidden": ([(0, 0, 1, 1, "a < b")], "<table><!-- <td>no</td> --><tr><td>a < b<script>'</td><td>'</script></td></table>", dict(teds=1)),
    "prose": (CELLS, "no table here", dict(teds=0, table_parse_ok=0)),
}


def test_tables(spark):
    samples = [(n, True, c[1]) for n, c in TABLE_CASES.items()] + [("failed", False, None)]
    cells = [(n, *cell) for n, c in TABLE_CASES.items() for cell in c[0]]
    gold = spark.createDataFrame(cells, f"sample_id string, {tables.CELL}")
    out = tables.score_tables(spark.createDataFrame(samples, "sample_id string, ok boolean, output string"), gold)
    check(out.collect(), {**TABLE_CASES, "failed": (tables.WORST,)})
    rendered = {r.sample_id: r.html for r in tables.render_tables(gold).collect()}
    assert rendered["equal"] == HTML


def forest_distance(f, g, seen):
    """The defining recursion over rightmost roots; nodes are (label, children)."""
    if (f, g) not in seen:
        size = lambda t: sum(1 + size(c) for _, c in t)
        if not f or not g:
            seen[f, g] = size(f) + size(g)
        else:
            (x, kids_x), (y, kids_y) = f[-1], g[-1]
            seen[f, g] = min(
                forest_distance(f[:-1] + kids_x, g, seen) + 1, forest_distance(f, g[:-1] + kids_y, seen) + 1,
                forest_distance(kids_x, kids_y, seen) + forest_distance(f[:-1], g[:-1], seen) + rename(x, y))
    return seen[f, g]


def rename(x, y):
    """Labels are ("table",), ("tr",) and ("td", col_span, row_span, text)."""
    if x == y:
        return 0.0
    if x[:3] != y[:3]:
        return 1.0
    return plain_distance(x[3], y[3]) / max(len(x[3]), len(y[3]))


def plain_distance(x, y):
    line = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        above, line = line, [i]
        for j, d in enumerate(y, 1):
            line.append(min(above[j] + 1, line[-1] + 1, above[j - 1] + (c != d)))
    return line[-1]


@pytest.mark.parametrize("small, band", [(3000, 16), (0, 16), (0, 1)])
def test_table_distance_equals_the_tree_recursion(monkeypatch, small, band):
    monkeypatch.setattr(table_distance, "SMALL_CELLS", small)
    monkeypatch.setattr(table_distance, "LEAST_BAND", band)
    tree = lambda t: ((("table",), tuple((("tr",), tuple((("td", *cell), ()) for cell in row)) for row in t)),)
    rng = random.Random(9)
    cell = lambda: (rng.choice([1, 1, 2]), 1, "".join(rng.choice("xy") for _ in range(rng.randint(0, 3))))
    for k in range(120):
        a, b = ([[cell() for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 4))] for _ in range(2))
        if k % 2:  # a few edits
            b = [list(row) for row in a]
            for _ in range(2):
                b.insert(rng.randint(0, len(b)), [cell()])
                b[rng.randrange(len(b))] += [cell()]
            del b[rng.randrange(len(b))]
        assert table_distance.distance(a, b) == pytest.approx(forest_distance(tree(a), tree(b), {})), (a, b)
    one_row, two_rows = [[(1, 1, "x"), (1, 1, "y"), (1, 1, "z")]], [[(1, 1, "x"), (1, 1, "y")], [(1, 1, "z")]]
    assert [table_distance.distance(two_rows, t) for t in (two_rows, one_row, two_rows[1:], [])] == [0, 3, 3, 5]


def test_wide_tables_cost_a_band(monkeypatch):
    """A table of 200 x 20 cells with scattered edits meets few pairs of texts; long texts and the band's end."""
    rng = random.Random(4)
    a = [[(1, 1, f"{rng.randrange(10 ** 4)} {rng.choice('abc')}") for _ in range(20)] for _ in range(200)]
    b = [list(row) for row in a]
    for _ in range(20):
        b[rng.randrange(200)][rng.randrange(20)] = (1, 1, "?" * 9)
    b[7][3] = (1, 1, a[7][3][2] + "x" * 100)
    changed = sum(plain_distance(x[2], y[2]) / max(len(x[2]), len(y[2])) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
    del b[50]
    b.insert(100, a[3])
    seen = []
    costs = table_distance.Texts.costs
    monkeypatch.setattr(table_distance.Texts, "costs", lambda self, x, y: (seen.append(len(x)), costs(self, x, y))[1])
    start = time.process_time()
    assert table_distance.distance(a, b) == pytest.approx(changed + 42)
    assert sum(seen) < 4000 ** 2 / 5 and time.process_time() - start < 10  # about one second on a free core


def test_extract_tables(spark):
    pages = spark.createDataFrame([(1, f"<p>{HTML}<table><td rowspan=2>q</table></table><td>outside</td>"), (2, "| a | b |\n|---|---|\n| | c |"), (3, "none | here"), (4, "<table></table>\n| x |"), (5, None)], "page int, body string")
    got = sorted((r.page, r.table_no, r.row, r.col, r.col_span, r.row_span, r.text) for r in tables.extract_tables(pages, "page", "body").collect())
    assert got == [(1, 0, 0, 0, 3, 1, "Ports"), (1, 0, 1, 0, 1, 1, "Oslo"), (1, 0, 1, 1, 1, 1, "ice"), (1, 0, 1, 2, 1, 1, "fog & rain"), (1, 1, 0, 0, 1, 2, "q"),
                   (2, 0, 0, 0, 1, 1, "a"), (2, 0, 0, 1, 1, 1, "b"), (2, 0, 1, 0, 1, 1, ""), (2, 0, 1, 1, 1, 1, "c")]


def test_tables_are_read_in_one_pass(spark):
    """No sorting and summing over tokens, and what makes the pages is worked out once, not once for HTML and once for markdown."""
    made = spark.range(4).groupBy("id").agg(F.concat(F.lit("<table><td>"), F.max("id"), F.lit("&am<b>p;</table>")).alias("body"))
    out = tables.extract_tables(made, "id", "body")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Range (") == 1
    assert sorted((r.id, r.text) for r in out.collect()) == [(i, f"{i}&amp;") for i in range(4)]


def lines(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return list({" ".join(rng.choice(words) for _ in range(rng.randint(6, 10))) for _ in range(n)})


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "#", "##"]) + text[i + 1:]
    return text


def test_close_candidates_keep_every_close_pair(spark):
    """Against all pairs, over short and long texts with few and many edits."""
    rng = random.Random(12)
    gold = lines(rng, 40) + ["a", "ab", "abc d", "x y z w", "0123456789"]
    pred = [edited(rng, t, rng.choice([0, 1, 2, 5, 9])) for t in gold if t] + ["ab", "b", "0123456"]
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate(gold)], "s int, gi int, text string")
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(pred) if t], "s int, li int, text string")
    for least, size in matching.STAGES:
        got = {(r.gi, r.li) for r in matching.close_candidates(g, p, ["s"], "gi", "li", least, size).collect()}
        sim = lambda a, b: 1 - plain_distance(a, b) / max(len(a), len(b))
        want = {(i, j) for i, a in enumerate(gold) for j, b in enumerate(pred) if b and sim(a, b) >= least}
        assert want <= got


def test_candidates_grow_with_matches(spark):
    """A page of 10,000 distinct lines, each with a few errors."""
    rng = random.Random(13)
    gold = lines(rng, 10_000)
    order = list(range(len(gold)))
    rng.shuffle(order)
    pred = [edited(rng, gold[i], 3) for i in order]
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate(gold)], "s int, gi int, text string")
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(pred)], "s int, li int, text string")
    pairs = matching.close_candidates(g, p, ["s"], "gi", "li", *matching.STAGES[0])
    assert pairs.count() < 15 * len(gold)  # of 10,000 times as many pairs, over only 400 words
    found = {(r.gi, r.li) for r in matching.match_texts(g, p, ["s"], "gi", "li", reading_order.text_similarity).collect()}
    assert len(found) == len(gold) and sum((order[li] == gi) for gi, li in found) > 0.999 * len(gold)


def test_staged_matching_equals_one_greedy_pass(spark, monkeypatch):
    rng = random.Random(14)
    rows = {}
    for s in range(6):
        gold = lines(rng, 25) * 1
        pred = [edited(rng, rng.choice(gold), rng.choice([1, 3, 8, 20])) or "x" for _ in range(30)]
        rows[s] = (gold, pred)
    g = spark.createDataFrame([(s, i, t) for s, (a, _) in rows.items() for i, t in enumerate(a)], "s int, gi int, text string")
    p = spark.createDataFrame([(s, i, t) for s, (_, b) in rows.items() for i, t in enumerate(b)], "s int, li int, text string")
    monkeypatch.setattr(matching, "MANY_PAIRS", 0)
    got = {(r.s, r.gi, r.li) for r in matching.match_texts(g, p, ["s"], "gi", "li", reading_order.text_similarity).collect()}
    want = set()
    for s, (a, b) in rows.items():
        sims = [(1 - plain_distance(x, y) / max(len(x), len(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b)]
        want |= {(s, i, j) for i, j in greedy([x for x in sims if x[0] >= 0.5])}
    assert got == want


def test_best_value_under_a_key(spark):
    rng = random.Random(15)
    text = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 9)))
    rows = [(i, text(), [text() for _ in range(rng.randint(0, 6))]) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, t string, o array<string>").select("i", kv.best_similarity(F.col("t"), F.col("o")).alias("v")).collect()
    sim = lambda a, b: 1 - plain_distance(a, b) / max(len(a), len(b)) if a or b else 1.0
    assert {r.i: r.v for r in got} == {i: pytest.approx(max((sim(t, x) for x in o), default=0.0)) for i, t, o in rows}


def test_matching_broadcasts_no_exploded_rows(spark, monkeypatch):
    """Rows that compress well come from small files; their cells must not be collected on the driver."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.materialise(df)

    monkeypatch.setattr(matching, "materialise", seen)
    items = spark.range(300).selectExpr("id as sample_id", "cast(0 as int) as gi", "cast(0 as int) as pi", "array(0.1D, 0.1D, 0.7D, 0.2D) as box")
    moved = items.withColumn("box", F.transform("box", lambda v: v + 0.01))
    out = matching.match_boxes(items.drop("pi"), moved.drop("gi"), ["sample_id"], "gi", "pi")
    assert out.count() == 300
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_replies_are_cleaned_once(spark):
    """Cleaning, finding and judging a reply share one pass; unwrapping starts only where something is nested."""
    rows = [(1, True, '{"a": "x", "b": [1, " ", 2]}'), (2, True, '<THINK>{"no": 1}</think> ```json\n{"data": {"result": {"a": " y"}}}\n```'), (3, True, "7"), (4, True, "none"),
            (5, False, None), (6, True, '{"data": "OBJECT<OBJECT<"}'), (7, True, '{"data": []}'), (8, True, '{"output": [{"name": "n", "value": "v"}]}')]
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    kept, kv.materialise = kv.materialise, seen
    try:
        out = kv.parsed_replies(spark.createDataFrame(rows, "sample_id int, ok boolean, output string"), F.col("ok")).collect()
    finally:
        kv.materialise = kept
    assert plans[0].count("(?is)<think>.*?</think>") == 1
    got = {r.sample_id: (r.parsed, [(s.key, s.raw) for s in r.said]) for r in out}
    assert got == {1: (True, [("a", "x"), ("b", "1"), ("b", "2")]), 2: (True, [("a", " y")]), 3: (True, []), 4: (False, []), 5: (False, []),
                   6: (True, [("data", "OBJECT<OBJECT<")]), 7: (True, []), 8: (True, [("n", "v")])}
