"""Suffix-array dedup: sparse suffix arrays over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ablatrix.llm.common import BLANKS, checkpointed, look_up, parts, ship, table

#: Words in the shortest repeat that is reported, and in the k-gram that a retained suffix begins with.
LEAST, GRAM = 50, 12
#: Suffixes of one k-gram that a task compares at most, some 15 MB; one with more places is matched by its windows.
OFTEN = 20_000
#: k-grams in a window.  Any LEAST words hold one whole window, and so a retained position.
WINDOW = LEAST - GRAM + 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known = {w: xxh64_intdigest(w) for w in set(tokens)}
    return np.array([known[w] for w in tokens], dtype=np.uint64)


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width values."""
    h = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + values[j : j + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def minimisers(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): in each window of k-grams the one of the smallest hash, the first where several are.

    What a window retains depends on its own words alone, so texts that share a window retain the same place in it.
    """
    if len(tokens) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _rolled(_word_hashes(tokens), GRAM)
    best = np.unique(_least(h))
    return best.astype(np.int64), h[best].view(np.int64)


def _least(h: np.ndarray) -> np.ndarray:
    """The position that each window of k-grams retains."""
    return np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, pos, h); within a task each text once."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, rows, positions, hashes = batch.column("digest").to_pylist(), [], [], []
        for digest, text in zip(digests, (t for some in parts(batch.column("body")) for t in some)):
            if digest not in seen:
                seen.add(digest)
                at, h = minimisers(words(text))
                rows += [digest] * len(at)
                positions.append(at)
                hashes.append(h)
        if rows:
            whole = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.concatenate(positions)), pa.array(np.concatenate(hashes))], ["digest", "pos", "h"])
            for a in range(0, whole.num_rows, 20_000):
                yield whole.slice(a, 20_000)


_SUFFIX = {"h": pa.int64(), "ahead": pa.binary(), "behind": pa.binary(), "digest": pa.binary(), "places": pa.list_(pa.int64())}


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each marked suffix of a k-gram that isn't too common: the words from it on, and those before it, nearest first.

    Suffixes of one text that are alike in both are one row with several places.
    """
    for batch in batches:
        out: list[list] = [[] for _ in _SUFFIX]
        for at in range(batch.num_rows):
            digest, text, marks = (batch.column(c)[at].as_py() for c in ("digest", "body", "marks"))
            tokens, alike = words(text), {}
            for mark in marks:
                if not mark["often"]:
                    p = mark["pos"]
                    around = (mark["h"], b" ".join(tokens[p : p + LEAST]), b" ".join(reversed(tokens[max(0, p - LEAST + GRAM) : p])))
                    alike.setdefault(around, []).append(p)
            for around, places in alike.items():
                for column, value in zip(out, (*around, digest, sorted(places))):
                    column.append(value)
            if len(out[0]) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SUFFIX.values())], list(_SUFFIX))
                out = [[] for _ in _SUFFIX]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SUFFIX.values())], list(_SUFFIX))


def _common(a: bytes, b: bytes) -> int:
    """Words that both begin with."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    n = 0
    for x, y in zip(a.split(), b.split()):
        if x != y:
            break
        n += 1
    return n


def _pairs(run: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted run: each suffix with the nearest one of another text on either side."""
    block: list[int] = []  # suffixes of one text that stand together
    before = -1  # the last one of another text before them
    for i, row in enumerate(run):
        if block and row[2] != run[block[-1]][2]:
            yield from ((j, i) for j in block)
            before, block = block[-1], [i]
        else:
            if before >= 0:
                yield before, i
            block.append(i)


def matches(run: list[tuple[bytes, bytes, bytes, list[int]]]) -> dict[bytes, list[tuple[int, int]]]:
    """(start, end) by text of the matches of LEAST words or more between different texts, in the suffixes of one k-gram.

    A suffix is (words ahead, words behind, text, places).  Neighbours in the order by words ahead share most words
    ahead, in the order by words behind most words behind.  A third text may share more of both together than either
    neighbour; where the figures leave that open for any suffix, all windows of LEAST words around the k-gram are compared.
    """
    found: dict[bytes, set[tuple[int, int]]] = {}

    def span(row: tuple, left: int, right: int) -> None:
        at = found.setdefault(row[2], set())
        for p in row[3]:
            at.add((p - left, p + right))

    ahead, behind, both = ([0] * len(run) for _ in range(3))
    for far, order in ((ahead, range(len(run))), (behind, sorted(range(len(run)), key=lambda i: run[i][1::-1] + run[i][2:]))):
        order = list(order)
        for x, y in _pairs([run[i] for i in order]):
            i, j = order[x], order[y]
            right, left = _common(run[i][0], run[j][0]), _common(run[i][1], run[j][1])
            for k in (i, j):
                far[k] = max(far[k], right if far is ahead else left)
                both[k] = max(both[k], left + right)
            if right >= GRAM and left + right >= LEAST:
                span(run[i], left, right)
                span(run[j], left, right)
    if any(a + b >= LEAST and c < a + b for a, b, c in zip(ahead, behind, both)):
        for i, left in _shared_windows(run):
            span(run[i], left, LEAST - left)
    return {digest: _joined(spans) for digest, spans in found.items()}


def _shared_windows(run: list[tuple]) -> Iterator[tuple[int, int]]:
    """(suffix, words before its place) of the windows of LEAST words around the k-gram that two texts hold."""
    texts = {digest: k for k, digest in enumerate({row[2] for row in run})}
    hashes, of, left = [], [], []
    for i, row in enumerate(run):
        back = row[1].split()
        around = back[::-1] + row[0].split()
        if len(around) >= LEAST:
            w = _rolled(_word_hashes(around), LEAST)[: len(back) + 1]
            hashes.append(w)
            of.append(np.full(len(w), i))
            left.append(len(back) - np.arange(len(w)))
    if hashes:
        _, same = np.unique(np.concatenate(hashes), return_inverse=True)
        of, left = np.concatenate(of), np.concatenate(left)
        text = np.array([texts[row[2]] for row in run])[of]
        low, high = np.full(same.max() + 1, len(texts)), np.full(same.max() + 1, -1)
        np.minimum.at(low, same, text)
        np.maximum.at(high, same, text)
        at = np.flatnonzero((low < high)[same])
        yield from zip(of[at].tolist(), left[at].tolist())


def _joined(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """matches() of each k-gram of a sorted partition, one run of OFTEN suffixes at most after the other."""

    def batch_of(run: list[tuple]) -> pa.RecordBatch:
        spans = [(digest, *s) for digest, found in matches(run).items() for s in found] if len(run) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["digest", "start", "end"])

    run, of = [], None
    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in _SUFFIX)):
            if h != of:
                if run:
                    yield batch_of(run)
                run, of = [], h
            run.append(tuple(row))
    yield batch_of(run)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, start, h, w): every window of LEAST words that retains a common k-gram, w the hash of its words.

    A window retains one place, by its own words; texts that share the window share that k-gram.
    """
    names, types = ("digest", "start", "h", "w"), (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        for at in range(batch.num_rows):
            often = [m["pos"] for m in batch.column("marks")[at].as_py() if m["often"]]
            if not often:
                continue
            digest, hashes = batch.column("digest")[at].as_py(), _word_hashes(words(batch.column("body")[at].as_py()))
            h, w = _rolled(hashes, GRAM), _rolled(hashes, LEAST).view(np.int64)
            least = _least(h)
            starts = np.flatnonzero(np.isin(least, often))
            for a in range(0, len(starts), 20_000):
                start = starts[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([digest] * len(start), start, h[least[start]].view(np.int64), w[start]), types)], names)


def _repeated_windows(held: DataFrame) -> DataFrame:
    """(digest, start, end) of the windows around common k-grams that stand in two texts."""
    windows = held.select("digest", "body", "marks").mapInArrow(_windows, "digest binary, start long, h long, w long")
    windows = windows.select("digest", "start", F.concat_ws("/", "h", "w").alias("window"))
    twice = windows.groupBy("window").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    twice = checkpointed(twice.filter("low < high").select("window", "n"))
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = look_up(windows, twice, "window", "n", total, F.col("digest")).filter("n IS NOT NULL")
    return found.select("digest", "start", (F.col("start") + LEAST).alias("end"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN) -> DataFrame:
    """Passages of LEAST words or more that stand in two different texts, or in two rows of one text.

    1. Each text, copies once, retains the suffixes at its minimiser positions: any passage of LEAST words holds one.
    2. Only suffixes whose k-gram occurs in another text go on, with the words around them.
    3. Suffixes are sorted by k-gram and words ahead, and those of a k-gram by words behind too.  Neighbours of different
       texts are compared word by word and their match extended right and left; see matches().
    4. A k-gram with more than ``often`` places would be too much for one task.  All windows of LEAST words that retain
       it are keyed by a hash, counted with a map-side combine, and those that two texts hold are matches.  Both ways
       find every match.
    5. The matches of a text are joined to maximal spans.  A text of LEAST words or more that several rows hold is one
       span from end to end.

    Returns id, n_words, start_word, end_word (exclusive), one row a span, none for a document without repeats; a passage
    that repeats inside one document alone is none.  Words are runs of anything but white space, A-Z in lower case.  Null
    text counts as empty.  Ids may be null; rows that repeat an id and text are copies of each other.  An empty table gives
    an empty result; texts of any length are read whole; other columns play no part.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"), F.unhex(F.md5(body)).alias("digest"))
    retained = checkpointed(source.select("digest", "body").mapInArrow(_select, "digest binary, pos long, h long"))
    shared = retained.groupBy("h").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    shared = checkpointed(shared.filter("low < high").select("h", "n"))
    marks = look_up(retained, shared, "h", "n", retained.count(), F.col("digest")).filter("n IS NOT NULL")
    marks = marks.groupBy("digest").agg(F.collect_set(F.struct("pos", "h", (F.col("n") > often).alias("often"))).alias("marks"))
    texts = source.groupBy("digest").agg(F.first("body").alias("body"))
    held = checkpointed(texts.join(marks, "digest").select("digest", "body", "marks"))
    suffixes = held.mapInArrow(_suffixes, "h long, ahead binary, behind binary, digest binary, places array<long>")
    spans = suffixes.repartition("h").sortWithinPartitions("h", "ahead", "behind", "digest").mapInArrow(_neighbours, "digest binary, start long, end long")
    spans = spans.unionByName(_repeated_windows(held)).distinct()
    by_start = Window.partitionBy("digest").orderBy("start", "end")
    joined = (
        spans.withColumn("reach", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_start))
        .groupBy("digest", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    rows = source.select("id", "digest", F.size(F.filter(F.split("body", BLANKS), lambda w: w != "")).cast("long").alias("n_words"))
    rows = checkpointed(rows.filter(F.col("n_words") >= LEAST))
    counts = checkpointed(rows.groupBy("digest").agg(F.count("*").alias("n")).join(joined, "digest", "left").filter("n > 1 OR spans IS NOT NULL"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = rows.withColumn("digest", F.lower(F.hex("digest")))
    out = look_up(rows, counts.withColumn("digest", F.lower(F.hex("digest"))), "digest", "n", total, F.col("id")).filter("n IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    out = out.withColumn("span", F.explode(F.when(F.col("n") > 1, whole).otherwise(F.col("spans"))))
    return out.select(F.col("id").alias(id_col), "n_words", F.col("span.start").alias("start_word"), F.col("span.end").alias("end_word"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
