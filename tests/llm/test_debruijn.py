"""Substring dedup by the De Bruijn graph, against all windows of a table."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import EDGES, docs_of

from ablatrix.llm import debruijn
from ablatrix.llm.debruijn import LEAST


def words_of(text):
    return (text or "").encode().split()


def by_hand(rows):
    windows = Counter()
    split = [words_of(t) for _, t in rows]
    for w in split:
        windows.update(tuple(w[i : i + LEAST]) for i in range(len(w) - LEAST + 1))
    out = []
    for (i, _), w in zip(rows, split):
        keep = [True] * len(w)
        for a in range(len(w) - LEAST + 1):
            if windows[tuple(w[a : a + LEAST])] > 1:
                keep[a : a + LEAST] = [False] * LEAST
        out.append((str(i), len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out)


def invented(seed):
    """Texts that share passages of 30 to 90 words, some edited, in their order or another, inside a text too, and texts that go round."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(rng.randint(30, 90)) for _ in range(6)]
    texts = []
    for _ in range(25):
        w = fresh(rng.randint(0, 20))
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            w += p + fresh(rng.choice((0, 0, 3, 20)))
        texts.append(w)
    texts += [["a", "b", "c"] * 30, ["b", "c", "a"] * 20, ["x"] * (LEAST + 1), ["x"] * LEAST, ["y"] * LEAST, texts[3] + texts[3], texts[4], fresh(LEAST - 1), [*passages[0], *passages[0]]]
    return [(i, rng.choice((" ", "\n", "  \t")).join(w)) for i, w in enumerate(texts)]


def found(docs, **options):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in debruijn.substring_dedup(docs, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_every_window(spark, seed):
    rows = invented(seed)
    wanted = by_hand(rows)
    assert found(docs_of(spark, rows)) == wanted and sum(r[2] for r in wanted) > 500


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table."""
    long = " ".join(str(i) for i in range(60_000))
    rows = EDGES + [(20, long), (None, long + " more"), (21, "Ä ö " * 40), (21, "Ä ö " * 40), (22, "ä ö " * 17 + "end")]
    docs = docs_of(spark, rows)
    assert found(docs) == by_hand(rows)
    assert found(docs.filter(F.lit(False))) == []


def test_windows_that_share_a_hash_are_told_apart(spark):
    """With a few hundred hashes for all windows, most meet by chance; the words decide."""

    def few(values, width):
        return debruijn.rolled(values, width) % np.uint64(300)

    rows = invented(5)
    assert found(docs_of(spark, rows), hashes=few) == by_hand(rows)


def test_rolled_runs_and_windows(monkeypatch):
    """Equal runs, and only these, have equal hashes, whatever stands around them; windows stay inside their text."""
    values = np.random.default_rng(1).integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 2, 3, 7, 10, 34, 35):
        h = debruijn.rolled(values, width)
        runs = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert len(h) == len(runs) and len(set(zip(h.tolist(), runs))) == len(set(runs)) == len(set(h.tolist()))
    assert len(debruijn.rolled(values[:5], 6)) == 0
    begin, row = debruijn._windows(np.array([0, 35, 75]), np.array([35, 40, 36]))
    assert begin.tolist() == [0, *range(35, 41), 75, 76] and row.tolist() == [0] + [1] * 6 + [2, 2]


def test_texts_are_hashed_in_groups(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "TOGETHER", 100)
    import pyarrow as pa

    rows = [(i, t) for i, t in invented(9) if t]
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    batch = pa.RecordBatch.from_arrays([pa.array([press.compress(t.encode()) for _, t in rows]), pa.array([i for i, _ in rows])], ["packed", "t"])
    out = [pair for b in debruijn._anchors(iter([batch])) for pair in zip(b.column("t").to_pylist(), b.column("h").to_pylist())]
    monkeypatch.setattr(debruijn, "TOGETHER", 1 << 20)
    assert out == [pair for b in debruijn._anchors(iter([batch])) for pair in zip(b.column("t").to_pylist(), b.column("h").to_pylist())]
    wanted = []
    for t, text in ((i, words_of(x)) for i, x in rows):
        if len(text) >= LEAST:
            h = debruijn.rolled(np.array([debruijn.xxh64_intdigest(w) for w in text], dtype=np.uint64), debruijn.GRAM)
            least = {min(h[a : a + debruijn.WINDOW]) for a in range(len(h) - debruijn.WINDOW + 1)}
            wanted += [(t, int(np.int64(x))) for i, x in enumerate(h) if any(min(h[a : a + debruijn.WINDOW]) == x for a in range(max(0, i - debruijn.WINDOW + 1), min(i, len(h) - debruijn.WINDOW) + 1)) and x in least]
    assert sorted(out) == sorted((t, int(np.uint64(x & (2**64 - 1)).astype(np.int64))) for t, x in wanted)


def test_slices_of_a_text_may_be_read_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "SLICES", 3)
    rows = invented(6)
    assert found(docs_of(spark, rows)) == by_hand(rows)


def test_paths_are_compacted(spark):
    """A passage that texts hold whole and in parts is one path; where texts go on differently a path ends."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q, r = fresh(200), fresh(60), fresh(60)
    texts = [p[:120] + fresh(5), fresh(5) + p[80:], fresh(3) + p[30:100], p[40:150], fresh(60) + p[110:] + q, fresh(4) + p[100:] + q, p[150:] + r, fresh(2) + p[140:] + r]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = docs_of(spark, rows)
    spans = debruijn.repeated_passages(docs).collect()
    assert len({s.path for s in spans if s.end_word - s.start_word > LEAST and s.doc_id < 4}) == 1
    assert len({s.path for s in spans}) == 3
    content = {}
    for s in spans:  # equal places of a path begin with the same words
        words = words_of(rows[s.doc_id][1])[s.start_word : s.end_word]
        assert all(content.setdefault((s.path, s.path_start + i), w) == w for i, w in enumerate(words))
    assert found(docs) == by_hand(rows)


def test_rings_stay_apart(spark):
    schema = "e long, n long, lo long, l long, r long"
    place = lambda t, i: (t << debruijn.PLACE_BITS) + i
    edges = [(1, 2, place(0, 0), 10, 11), (2, 2, place(1, 5), 11, 12), (3, 2, place(0, 7), 12, 10), (4, 2, place(2, 0), 20, 21), (5, 2, place(2, 1), 21, 22), (6, 2, place(3, 4), 22, 23), (7, 2, place(4, 4), 23, 24)]
    graph = debruijn.chains(spark.createDataFrame(edges, schema))
    assert {r.e: r.chain for r in graph.collect()} == {1: place(0, 0), 2: place(1, 5), 3: place(0, 7), 4: place(2, 0), 5: place(2, 0), 6: place(3, 4), 7: place(4, 4)}
    wanted = {(place(0, 0), place(0, 0), 0), (place(1, 5), place(1, 5), 0), (place(0, 7), place(0, 7), 0), (place(2, 0), place(2, 0), 0), (place(3, 4), place(2, 0), 2), (place(4, 4), place(2, 0), 3)}
    assert {(r.chain, r.path, r.before) for r in debruijn.paths(graph).collect()} == wanted
