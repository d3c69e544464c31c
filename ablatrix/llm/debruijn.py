"""Substring dedup: a De Bruijn graph of word k-mers, compacted to paths whose places in the texts are verified."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ablatrix.llm.common import HOT_SLOTS, checkpointed, look_up, parts, ship, table

#: Words of a window, which is an edge; a node is one word shorter.
LEAST = 35
#: Words of the grams of which each window retains one, the one of the least hash; and grams in a window.
GRAM = 10
WINDOW = LEAST - GRAM + 1
#: A place is text number << PLACE_BITS | word: texts of up to 2 ** 27 words, and 2 ** 36 texts.
PLACE_BITS = 27
#: Slices of one text that are digested together.
SLICES = 20_000
#: Words of texts whose windows are hashed together.
TOGETHER = 1 << 20

Hashes = Callable[[np.ndarray, int], np.ndarray]


def _text_of(place: Column) -> Column:
    return F.shiftright(place, PLACE_BITS)


def _word_of(place: Column) -> Column:
    return place.bitwiseAND((1 << PLACE_BITS) - 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, packed, n): of texts that are equal in a batch one, compressed, with their number."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at, packed, n = {}, [], []
        digests = iter(batch.column("digest").to_pylist())
        for texts in parts(batch.column("body")):
            for text in texts:
                i = at.setdefault(next(digests), len(at))
                if i == len(n):
                    packed.append(press.compress(text.encode()))
                    n.append(0)
                n[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(at.keys(), pa.string()), pa.array(packed, pa.binary()), pa.array(n, pa.int64())], ["digest", "packed", "n"])


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width values: a polynomial's value, put together from runs of 1, 2, 4 ... values, and mixed."""
    size = max(len(values) - width + 1, 0)
    total, done, power, run, length = np.zeros(size, dtype=np.uint64), 0, 0x9E3779B97F4A7C15, values, 1
    while done < width:
        if width & length:
            total = total * np.uint64(power) + run[done : done + size]
            done += length
        run, power, length = run[:-length] * np.uint64(power) + run[length:], power * power % (1 << 64), 2 * length
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ total >> np.uint64(32)


def _unpacked(batch: pa.RecordBatch, *others: str) -> Iterator[tuple]:
    """(words, others ...) of each row; words are runs of anything but ASCII white space."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    columns = [batch.column(c) for c in ("packed", *others)]
    for i in range(batch.num_rows):
        packed, *rest = (c[i].as_py() for c in columns)
        yield open_.decompress(packed).split(), *rest


def _together(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """(hashes, starts, rows): the word hashes of texts of LEAST words or more one after the other, with where each begins.

    TOGETHER words or one longer text at a time: windows of many texts are worked out in one go.
    """
    values, starts, rows, size = [], [], [], 0
    for batch in batches:
        for words, *rest in _unpacked(batch, *others):
            if len(words) < LEAST:
                continue
            if rows and size + len(words) > TOGETHER:
                yield np.concatenate(values), np.array(starts), rows
                values, starts, rows, size = [], [], [], 0
            values.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
            starts.append(size)
            rows.append((*rest, len(words)))
            size += len(words)
    if rows:
        yield np.concatenate(values), np.array(starts), rows


def _windows(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, row): where each window of a group of texts begins, and the row of its text; none reaches into the next text."""
    count = lengths - (LEAST - 1)
    row = np.repeat(np.arange(len(starts)), count)
    first = np.cumsum(count) - count
    return np.arange(len(row)) - first[row] + starts[row], row


def numbered(texts: DataFrame) -> DataFrame:
    """texts, which are checkpointed, with a column t: 0, 1, 2 ... in the order of partitions; one number a partition is gathered."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    own = texts.withColumns({"part": F.spark_partition_id(), "row": row})
    sizes = {r.part: r.n for r in own.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    first = texts.sparkSession.createDataFrame(starts, "part int, first long")
    return own.join(F.broadcast(first), "part").withColumn("t", F.col("first") + F.col("row")).drop("part", "row", "first")


def _slid(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least (or largest) of each width values in a row, from runs of 1, 2, 4 ... values."""
    run, length = values, 1
    while 2 * length <= width:
        run, length = pick(run[:-length], run[length:]), 2 * length
    rest = width - length
    return pick(run[: len(run) - rest], run[rest:]) if rest else run


def retained(h: np.ndarray) -> np.ndarray:
    """The gram hash that each window retains, the least: windows of the same words retain the same one."""
    return _slid(h, WINDOW, np.minimum)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, h): the hash of each gram, place by place, that some window of a text retains."""
    for values, starts, rows in _together(batches, "t"):
        t, lengths = (np.array(c, dtype=np.int64) for c in zip(*rows))
        h = rolled(values, GRAM)
        begin, row = _windows(starts, lengths)
        least = np.zeros(len(h) + WINDOW - 1, dtype=np.uint64)  # none where no window of one text begins
        least[begin + WINDOW - 1] = retained(h)[begin]
        at = np.flatnonzero(_slid(least, WINDOW, np.maximum) == h)  # some window that holds the gram retains its hash
        of = np.searchsorted(starts, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(t[of]), pa.array(h[at].view(np.int64))], ["t", "h"])


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values that are among the wanted ones; equal neighbours, of which there are many, are looked up once."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return np.repeat(np.isin(values[first], wanted), np.diff(np.append(first, len(values))))


def _edges(hashes: Hashes, nodes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(e, place), and with nodes (e, l, r, place), of each window whose retained gram is marked: an edge e from node l to node r."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, starts, rows in _together(batches, "t", "marks"):
            texts, marks, lengths = zip(*rows)
            t, lengths = np.array(texts, dtype=np.int64), np.array(lengths, dtype=np.int64)
            begin, row = _windows(starts, lengths)
            chosen = _among(retained(rolled(values, GRAM))[begin], np.unique(np.concatenate([np.array(m, dtype=np.int64) for m in marks])).view(np.uint64))
            begin, row = begin[chosen], row[chosen]
            columns = {"e": hashes(values, LEAST).view(np.int64)[begin]}
            if nodes:
                node = hashes(values, LEAST - 1).view(np.int64)
                columns |= {"l": node[begin], "r": node[begin + 1]}
            columns["place"] = begin - starts[row] + (t[row] << PLACE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    return emit


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, pos, width, sha): SHA-256 of the asked slices' words."""
    import hashlib

    for batch in batches:
        for words, t, slices in _unpacked(batch, "t", "slices"):
            sha = [hashlib.sha256(b" ".join(words[s["pos"] : s["pos"] + s["width"]])).digest() for s in slices]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(sha)), pa.array([s["pos"] for s in slices], pa.int64()), pa.array([s["width"] for s in slices], pa.int64()), pa.array(sha, pa.binary())], ["t", "pos", "width", "sha"]
            )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n, n_words, n_removed, kept): each text without the words of its spans; all of it, if it has copies, spans or not."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for words, digest, n, spans in _unpacked(batch, "digest", "n", "spans"):
            keep = np.ones(len(words), dtype=bool)
            if n > 1 and len(words) >= LEAST:
                keep[:] = False
            for s in spans or ():
                keep[s["start"] : s["end"]] = False
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode()
            for column, value in zip(out, (digest, n, len(words), len(words) - int(keep.sum()), kept)):
                column.append(value)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["digest", "n", "n_words", "n_removed", "kept"])


def _look_up(rows: DataFrame, found: DataFrame, key: str, total: int, spread: str) -> DataFrame:
    """Inner join of rows(key, spread) with found(key, n, ...), n being the rows of a key, without key and n.

    Keys of total / HOT_SLOTS rows or more, HOT_SLOTS at most, are broadcast; rows that this settles pass through the shuffle
    of the others dealt out by spread.
    """
    values = [c for c in found.columns if c not in (key, "n")]
    least = max(total // HOT_SLOTS, 64)
    hot = found.filter(F.col("n") >= least).select(F.col(key).alias("hot_key"), *(F.col(c).alias(f"hot_{c}") for c in values))
    cold = found.filter(F.col("n") < least).select(F.col(key).alias("cold_key"), *(F.col(c).alias(f"cold_{c}") for c in values))
    settled = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    open_ = F.col("hot_key").isNull()
    dealt = settled.select(spread, F.when(open_, F.col(key)).otherwise(F.xxhash64(spread)).alias("dealt"), open_.alias("open"), *(f"hot_{c}" for c in values))
    joined = dealt.join(cold, (F.col("dealt") == F.col("cold_key")) & F.col("open"), "left").filter(~F.col("open") | F.col("cold_key").isNotNull())
    return joined.select(spread, *(F.when(F.col("open"), F.col(f"cold_{c}")).otherwise(F.col(f"hot_{c}")).alias(c) for c in values))


def _release(df: DataFrame) -> DataFrame:
    """Have Spark drop the shuffles and checkpoints that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def repeated_edges(edges: DataFrame) -> DataFrame:
    """(e, n, lo, l, r) of the edges with two places or more; lo is the first place, and stands for the edge."""
    return edges.groupBy("e").agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.min("l").alias("l"), F.min("r").alias("r")).filter("n > 1")


def chains(edges: DataFrame) -> DataFrame:
    """edges(e, n, lo, l, r) with chain, the first place of the run that an edge is in, and goes_on.

    A node with one edge in and one out doesn't branch, and an edge that ends in one goes on.  Edges whose first places
    follow each other in a text, each going on to the next, are a run.
    """
    ends = F.explode(F.array(F.struct(F.col("l").alias("v"), F.lit(0).alias("in"), F.lit(1).alias("out")), F.struct(F.col("r").alias("v"), F.lit(1).alias("in"), F.lit(0).alias("out"))))
    nodes = edges.select(ends.alias("x")).select("x.*").groupBy("v").agg(F.sum("in").alias("in"), F.sum("out").alias("out"))
    single = nodes.filter("in = 1 AND out = 1").select("v")
    marked = edges.join(single, F.col("r") == F.col("v"), "left").select(*edges.columns, F.col("v").isNotNull().alias("goes_on"))
    text = Window.partitionBy(_text_of(F.col("lo"))).orderBy("lo")
    follows = (F.lag("lo").over(text) == F.col("lo") - 1) & F.lag("goes_on").over(text)
    started = marked.withColumn("head", F.when(~F.coalesce(follows, F.lit(False)), F.col("lo")))
    return started.withColumn("chain", F.max("head").over(text)).drop("head")


def paths(chained: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(chain, path, before): the path that each chain is part of, by its first chain, and the edges of the path before it.

    Chains are joined at nodes that don't branch, by pointer doubling from each chain to the one before.  In a round in
    which no further chain reaches a start, all that are left go round in rings, as periodic text does; these stay apart.
    """
    runs = chained.groupBy("chain").agg(F.count("*").alias("edges"), F.min_by("l", "lo").alias("l"), F.max_by("r", "lo").alias("r"), F.max_by("goes_on", "lo").alias("goes_on"))
    runs = checkpointed(runs)
    left = runs.filter("goes_on").select(F.col("r").alias("node"), F.col("chain").alias("up"), F.col("edges").alias("before"))
    linked = runs.join(left, F.col("l") == F.col("node"), "left").select("chain", F.coalesce("up", "chain").alias("path"), F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.col("up").isNull().alias("ends"))
    linked, open_ = checkpointed(linked), None
    for _ in range(max_rounds):
        now = linked.filter("NOT ends").count()
        if now in (0, open_):
            break
        open_ = now
        up = linked.select(F.col("chain").alias("via"), F.col("path").alias("further"), F.col("before").alias("more"), F.col("ends").alias("up_ends"))
        stepped = linked.filter("NOT ends").join(up, F.col("path") == F.col("via"))
        stepped = stepped.select("chain", F.col("further").alias("path"), (F.col("before") + F.col("more")).alias("before"), F.col("up_ends").alias("ends"))
        linked = checkpointed(linked.filter("ends").unionByName(stepped))
    ring = ~F.col("ends")
    return linked.select("chain", F.when(ring, F.col("chain")).otherwise(F.col("path")).alias("path"), F.when(ring, 0).otherwise(F.col("before")).cast("long").alias("before"))


def runs_of_places(places: DataFrame) -> DataFrame:
    """(t, pos, edges, lo, chain) of places(place, lo, chain): stretches of a text that follow a chain edge by edge."""
    text = Window.partitionBy("t").orderBy("place")
    same = (F.lag("place").over(text) == F.col("place") - 1) & (F.lag("lo").over(text) == F.col("lo") - 1) & (F.lag("chain").over(text) == F.col("chain"))
    begun = places.withColumn("t", _text_of(F.col("place"))).withColumn("begin", F.when(~F.coalesce(same, F.lit(False)), F.col("place")))
    begun = begun.withColumn("begin", F.max("begin").over(text))
    return begun.groupBy("t", "begin").agg(F.count("*").alias("edges"), F.min("lo").alias("lo"), F.min("chain").alias("chain")).select("t", _word_of(F.col("begin")).alias("pos"), "edges", "lo", "chain")


def slice_digests(slices: DataFrame, held: DataFrame) -> DataFrame:
    """(t, pos, width, sha) of distinct slices(t, pos, width) of held(t, packed); a text of very many slices is read in several tasks."""
    slices = slices.distinct()
    count = slices.groupBy(F.col("t").alias("of")).agg(F.count("*").alias("asked"))
    share = F.pmod(F.xxhash64("pos", "width"), F.ceil(F.col("asked") / SLICES))
    asked = slices.join(count, F.col("t") == F.col("of")).groupBy("t", share.alias("share")).agg(F.collect_list(F.struct("pos", "width")).alias("slices"))
    return held.select("t", "packed").join(asked.drop("share"), "t").mapInArrow(_digests, "t long, pos long, width long, sha binary")


def verified(spans: DataFrame, held: DataFrame) -> DataFrame:
    """(t, start, end, chain, at): the words of spans(t, pos, edges, lo, chain) that stand elsewhere too, word for word.

    at is the number of the chain's edges before the span, null for a window of a chain that was taken apart.

    The words of each span, but for those at first places, are held against those of the chain's first places, by SHA-256.  Where they differ, for two
    windows share a hash, the chain's spans are taken apart and its windows compared by SHA-256, one by one.
    """
    width = F.col("edges") + (LEAST - 1)
    spans = spans.withColumn("width", width).withColumns({"rep": _text_of(F.col("lo")), "rep_pos": _word_of(F.col("lo")), "at": F.col("lo") - F.col("chain")})
    first_place = (F.col("t") == F.col("rep")) & (F.col("pos") == F.col("rep_pos"))
    others = spans.filter(~first_place)
    both = others.select("t", "pos", "width").unionByName(others.select(F.col("rep").alias("t"), F.col("rep_pos").alias("pos"), "width"))
    sha = _release(checkpointed(slice_digests(both, held)))
    own = sha.select(*(F.col(c).alias(f"own_{c}") for c in sha.columns))
    first = sha.select(*(F.col(c).alias(f"first_{c}") for c in sha.columns))
    joined = others.join(own, (F.col("t") == F.col("own_t")) & (F.col("pos") == F.col("own_pos")) & (F.col("width") == F.col("own_width")))
    joined = joined.join(first, (F.col("rep") == F.col("first_t")) & (F.col("rep_pos") == F.col("first_pos")) & (F.col("width") == F.col("first_width")))
    told = joined.select("t", "pos", "edges", "chain", "at", (F.col("own_sha") == F.col("first_sha")).alias("same"))
    held_up = _release(checkpointed(told.unionByName(spans.filter(first_place).select("t", "pos", "edges", "chain", "at", F.lit(True).alias("same")))))
    good = held_up.select("t", F.col("pos").alias("start"), (F.col("pos") + F.col("edges") + (LEAST - 1)).alias("end"), "chain", "at")
    wrong = held_up.filter("NOT same").select(F.col("chain").alias("wrong")).distinct()
    if wrong.isEmpty():
        return good
    apart = held_up.join(wrong, F.col("chain") == F.col("wrong"), "left_semi").select("t", F.explode(F.sequence("pos", F.col("pos") + F.col("edges") - 1)).alias("pos"), F.lit(LEAST).cast("long").alias("width"), "chain")
    apart = checkpointed(apart)
    exact = checkpointed(slice_digests(apart.select("t", "pos", "width"), held))
    twice = exact.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha")
    again = exact.join(twice, "sha", "left_semi").select("t", "pos").join(apart.drop("width").distinct(), ["t", "pos"])
    again = again.select("t", F.col("pos").alias("start"), (F.col("pos") + LEAST).alias("end"), "chain", F.lit(None).cast("long").alias("at"))
    return good.join(wrong, F.col("chain") == F.col("wrong"), "left_anti").unionByName(again)


class Repeats:
    """The distinct texts of a table and the passages of LEAST words or more that repeat in or between them.

    1. Texts are taken once each, compressed and numbered.
    2. Each window of LEAST words retains one of its grams, the same wherever the window stands; only windows whose gram is
       retained in two places go on.
    3. A window is an edge between its first and its last LEAST - 1 words; edges with two places are the graph.
    4. Paths that don't branch are compacted: in runs of first places inside a text, and these by joins.
    5. Every place of an edge is looked up, edges of very many places by broadcast; stretches of places along a chain are
       spans, and their words are verified at both places.

    texts has (digest, packed, n copies, t); spans has (t, start, end, chain, at); paths has (chain, path, before).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: Hashes = rolled):
        ship(docs.sparkSession)
        body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(body, 256).alias("digest"))
        packed = docs.select(F.sha2(body, 256).alias("digest"), body.alias("body")).mapInArrow(_pack, "digest string, packed binary, n long")
        packed = packed.groupBy("digest").agg(F.first("packed").alias("packed"), F.sum("n").alias("n"))
        self.texts = numbered(checkpointed(packed))
        del packed
        self.held = _release(self._marked())
        self.hashes = hashes
        graph = _release(self._graph())
        self.paths = paths(graph)
        graph = _release(checkpointed(graph.select("e", "n", "lo", "chain")))
        spans = self._spans(graph)
        del graph
        self.spans = verified(_release(spans), self.held)
        self.held = None

    def _marked(self) -> DataFrame:
        """(t, packed, marks): the texts that hold a gram which is retained in two places, with the hashes of these grams."""
        anchors = checkpointed(self.texts.select("t", "packed").mapInArrow(_anchors, "t long, h long"))
        shared = checkpointed(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
        total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        marked = _look_up(anchors, shared.withColumn("mark", F.col("h")), "h", total, "t")
        marks = marked.groupBy("t").agg(F.collect_set("mark").alias("marks"))
        return checkpointed(self.texts.select("t", "packed").join(marks, "t"))

    def _graph(self) -> DataFrame:
        edges = self.held.mapInArrow(_edges(self.hashes, True), "e long, l long, r long, place long")
        return checkpointed(chains(_release(checkpointed(repeated_edges(edges)))))

    def _spans(self, graph: DataFrame) -> DataFrame:
        total = graph.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        edges = self.held.mapInArrow(_edges(self.hashes, False), "e long, place long")
        return checkpointed(runs_of_places(_look_up(edges, graph.select("e", "n", "lo", "chain"), "e", total, "place")))

    def cleaned(self) -> DataFrame:
        """(digest, n, n_words, n_removed, kept) of each distinct text."""
        cut = self.spans.groupBy("t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        return self.texts.join(cut, "t", "left").select("digest", "packed", "n", "spans").mapInArrow(_cleaned, "digest string, n long, n_words long, n_removed long, kept string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, path, path_start): where documents follow a path of the graph, and where on it.

    path names the compacted path; passages of one path and equal path_start begin with the same words (path_start is null
    where windows of other words share a hash with the path).  A document that has copies has only what other texts or
    places share with it.  Nulls, repeats and empty tables as in substring_dedup().
    """
    found = Repeats(docs, id_col, text_col)
    placed = found.spans.join(found.paths, "chain").join(found.texts.select("t", "digest"), "t")
    return found.rows.join(placed, "digest").select(F.col("id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "path", (F.col("before") + F.col("at")).alias("path_start"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: Column | None = None, hashes: Hashes = rolled) -> DataFrame:
    """Each document without the words of any window of LEAST words that also starts elsewhere, in it or in another row.

    Words are runs of anything but U+0020 and U+0009 to U+000D, unchanged; those kept are joined by one space.  Windows
    are judged on the input, so all places of a passage are removed.  ``kept`` is an expression on the column kept, the text
    without those words, as by default; ``hashes`` gives a hash of each run of so many word hashes.

    Returns id, n_words, n_removed, kept, a row for each row of docs.  Null text has no words.  Ids may be null and may
    repeat: rows of equal text are copies of each other, which go if they have LEAST words.  Texts of any length are read
    whole.  An empty table gives an empty result; other columns play no part.
    """
    found = Repeats(docs, id_col, text_col, hashes)
    cleaned = found.cleaned().select("digest", "n", "n_words", "n_removed", (F.col("kept") if kept is None else kept).alias("kept"))
    cleaned = checkpointed(cleaned)
    total = cleaned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = look_up(found.rows, cleaned, "digest", "n", total, F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), kept=F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT k, len(ws) AS size, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d
), five AS (
  SELECT *, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS w5 FROM p WINDOW o AS (PARTITION BY k ORDER BY i)
), w AS (
  SELECT k, i, word, CASE WHEN i <= size - 34 THEN sha256(concat_ws(' ', w5, lead(w5, 5) OVER o, lead(w5, 10) OVER o, lead(w5, 15) OVER o, lead(w5, 20) OVER o, lead(w5, 25) OVER o, lead(w5, 30) OVER o)) END AS h
  FROM five WINDOW o AS (PARTITION BY k ORDER BY i)
), g AS (
  SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1
), f AS (
  SELECT w.k, w.i, w.word, max(CASE WHEN g.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.k ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN g ON g.h = w.h
), s AS (
  SELECT k, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM f GROUP BY k
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.k = d.k
"""
