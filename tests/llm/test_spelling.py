"""Spelling variants: pivots and near pairs against comparing all words, and the whole operator against plain counting."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_llm import CLASHES, docs_of

from ablatrix.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def invented(letters, n, seed):
    """Words, and others an edit or two from them."""
    rng, found = random.Random(seed), set()
    while len(found) < n:
        w = list("".join(rng.choice(letters) for _ in range(rng.randint(7, 13))))
        found.add("".join(w))
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w[i : i + (kind != 0)] = [] if kind == 2 else [rng.choice(letters)]
            if len(w) >= 7:
                found.add("".join(w))
    return sorted(found)


def test_pivots_are_rare_and_disjoint():
    for word in invented("abcde", 300, 1) + ["aaaaaaa", "abababab", "aabbaabb"]:
        grams = Counter(word[i : i + 2] for i in range(len(word) - 1))
        ranks = {g: r for r, g in enumerate(sorted(grams))}
        prefix = spelling.prefix(word, ranks)
        first, second = spelling.pivots(prefix)
        of = {place: rank for rank, place in prefix}
        best = min(of[a] + of[b] for a in of for b in of if b - a >= 2)
        assert second - first >= 2 and of[first] + of[second] == best
        assert len(prefix) >= 3 and {r for r, _ in prefix} == {ranks[g] for g in sorted(grams)[: len({r for r, _ in prefix})]}


def test_near_pairs_are_all_found(spark):
    """Few letters, so that grams repeat and tie; many, so that they are rare; runs of one letter."""
    for letters, n in (("ab", 150), ("abcd", 400), ("abcdefghijklmnopqrstuvwxyzàéß÷", 500)):
        words = sorted(set(invented(letters, n, 7)) | {"a" * k for k in range(7, 12)} | {"a" * k + "b" for k in range(7, 10)} | {"ab" * 30 + c * k for c in "ab" for k in range(2, 9)})
        table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
        found = spelling.near_pairs(table, spelling.gram_ranks(table)).collect()
        wanted = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
        assert len(found) == len(wanted) > 50 and {(r.a, r.b) for r in found} == wanted
        assert all(words[r.a_n - 2] == r.a and words[r.b_n - 2] == r.b for r in found)


def by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) if xs and max(n[x] for x in xs) >= 10 * n[w] else None for w, xs in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), str(n[form[w]] if form[w] else None)) for w in n)


def test_variants_by_hand(spark):
    """Chains of forms, ties, damaged runs, capitals beyond ASCII, and the edges: nulls, empty and long texts, repeated rows."""
    rows = [(i, "Straßen ÉCOLES écoles naïveté " * 3) for i in range(40)]
    rows += [(100, "spelling " * 3000), (101, "spellinh " * 250), (102, "spelmnh spelxinh " * 20), (103, "spelxinhs " * 2), (104, "spellimh spellimh spellinx spellinx")]
    rows += [(None, "nothing nothing nothing x"), (None, "nothing nothing nothing x"), (7, None), (8, ""), (9, "nothings nothings"), (9, "nothings " * 50), (10, "short12words_only9 ab1"), (11, "z" * 50_000), (11, "z" * 50_000)]
    found = spelling.spelling_variants(docs_of(spark, rows)).collect()
    wanted = by_hand(rows)
    assert sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in found) == wanted
    assert any(form != "None" and root != form for _, form, root, *_ in wanted)


def test_rows_are_counted_over_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    rows = [(i, f"common words number {'abcdefg'[i % 7] * 8}") for i in range(1200)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "body"])]
    counts = Counter()
    for out in spelling._words(iter(batches)):
        for word, n in zip(out.column("word").to_pylist(), out.column("n").to_pylist()):
            counts[word] += n
    assert sorted((w, n) for w, n in counts.items() if n >= 2) == [(w, n) for w, _, _, n, *_ in by_hand(rows)]


def test_empty_table_and_other_columns(spark):
    docs = docs_of(spark, [(1, "some words here"), (2, "abcdefg abcdefg")])
    assert set(CLASHES) <= set(docs.columns)
    assert [tuple(r) for r in spelling.spelling_variants(docs).collect()] == [("abcdefg", None, "abcdefg", 2, 0, None)]
    assert spelling.spelling_variants(docs.filter(F.lit(False))).count() == 0
