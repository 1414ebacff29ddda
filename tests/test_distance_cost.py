"""What is settled by counts must not reach the table walk."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import distance as D
from scorelake.functions import metrics as M


class _Listed(Exception):
    pass


def test_left_out_kinds_need_no_walk_over_signs(monkeypatch):
    def walked(*_):
        raise _Listed

    monkeypatch.setattr(D, "iter", walked, raising=False)
    monkeypatch.setattr(D, "_within", walked)
    text = "no one knows in when the noon ends, " * 40
    assert D.bit_distance(text, text.replace("n", "")) == text.count("n")
    assert D.bit_distance(text.replace("n", "").replace("o", ""), text) == text.count("n") + text.count("o")
    with pytest.raises(_Listed):  # some of a kind are left: not settled this way
        D.bit_distance(text, text.replace("no", "o"))


def test_copies_of_a_reference_are_made_canonical_once(spark):
    df = spark.createDataFrame([(1, True, " a  b\tc ", [" a  b\tc "]), (2, True, "x", ["y  y", "x", None]), (3, True, None, None)],
                               "id int, ok boolean, output string, references array<string>")
    out = M.score_texts(df, ["cer", "exact_match", "length_ratio"])
    got = {r.id: (r.cer, r.exact_match, r.length_ratio) for r in out.collect()}
    assert got[1] == (0.0, 1.0, 1.0) and got[2][1] == 1.0 and got[3] == (1.0, 0.0, 0.0)
