"""Fill-in-middle: the matrix against plain counting, cuts and outputs against a rule written out by hand."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import CLASHES, EDGES, docs_of

from ablatrix.llm import fim

TEXTS = ["", "\n", "a\nb\n", "a\nb", "no end", "\n\n\n", "x <M> y\n", "Ünï\ncödé 𝄞\n\nend. Next!\n", "a  b\tc\r\nd", "9 Lives.\n" * 300]


def test_rank_counts_the_class_before_a_place():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix, places = fim.WaveletMatrix(values), np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, places).tolist() == [int((values[:p] == c).sum()) for p in places]


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_cuts_stand_where_units_end(unit):
    ends = {"line": "\n", "sentence": "\n.!?", "word": " \t\v\f\r\n"}
    split = (lambda t: list(t)) if unit == "character" else (lambda t: re.findall(f"[^{ends[unit]}]*[{ends[unit]}]|[^{ends[unit]}]+", t))
    for first, second in ((0, 0), (5, 2), (123_456_789, 987_654_321)):
        n, low, high = fim.units_and_cuts(TEXTS, np.full(len(TEXTS), first), np.full(len(TEXTS), second), unit)
        for text, *found in zip(TEXTS, n, low, high):
            units = split(text)
            a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
            assert found == [len(units), len("".join(units[:a])), len("".join(units[:b]))]


def by_hand(i, text, seed=7):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall("[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_rows_by_hand(spark):
    rows = EDGES + [(20 + i, t) for i, t in enumerate(TEXTS)] + [(40 + i, "one\ntwo <\nP>three\n<S\n> four\n") for i in range(8)]
    docs = docs_of(spark, rows)
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found) == sorted((str(i), *by_hand(i, t)) for i, t in rows)
    assert set(CLASHES) <= set(docs.columns) and fim.fill_in_middle(docs.filter("doc_id = -1")).count() == 0


def test_rates_leave_texts_plain_and_order_pieces(spark):
    docs = docs_of(spark, [(i, "a\nb\nc\n") for i in range(300)])
    forms = lambda **o: {r.form: r.n for r in fim.fill_in_middle(docs, **o).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert forms(rate=0) == {"plain": 300} and forms(spm_rate=0) == {"psm": 300}
    assert set(forms(rate=50)) == {"plain", "psm", "spm"} and 100 < forms(rate=50)["plain"] < 200


def test_long_texts_have_a_matrix_of_their_own(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "SHARED", 10)
    groups = list(fim._groups(pa.array(["abcd", None, "x" * 50, "ab", "cdefghi", "jk"])))
    assert [(at, [len(t) for t in texts]) for at, texts in groups] == [(0, [4, 0]), (2, [50]), (3, [2, 7]), (5, [2])]
