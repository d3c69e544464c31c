"""Best-fit packing: hierarchical residual packing of token sequences."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, parts, ship, table

CAPACITY = 2048
#: A bin that lacks at most so many tokens is nearly full and leaves at once.
NEARLY = 8
#: Groups of bins merged into one in each round, and rounds that suffice for any number of partitions: 16 ** 8 > 2 ** 31.
FAN, ROUNDS = 16, 8

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, bin string, bin_offset long, bin_fill long, grp long"


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, placed largest first into the fullest bin that still holds it."""
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    spaces: list[tuple[int, int]] = []  # (space left, bin), sorted
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(spaces, (sizes[i], -1))
        if at < len(spaces):
            space, number = spaces.pop(at)
        else:
            space, number, bins = capacity, bins, bins + 1
        place[i] = (number, capacity - space)
        if space > sizes[i]:
            insort(spaces, (space - sizes[i], number))
    return place


def carried(fills: list[tuple[int, str]], capacity: int, nearly: int, each: int) -> set[str]:
    """The bins that go on to the next round: of those that aren't nearly full, ``each`` of every fill at most.

    Bins of one fill are alike, and no more than ``each`` of them can be of use.  Best fit leaves no two bins in a group
    that fit together, so one of half the capacity or less at most; two bins merge only if one of them is such a bin.
    A round brings fan groups and so fan such bins together, each of which goes into one bin: in that round a group
    loses fan of its bins of one fill at most, in all rounds to come fan times their number.  With ``each`` that number
    the packing is the one that handing on every bin gives, and a group has capacity / 2 * each * fan bins at most.
    """
    found, taken = set(), Counter()
    for fill, name in sorted(fills):
        if capacity - fill > nearly and taken[fill] < each:
            taken[fill] += 1
            found.add(name)
    return found


def _pack_partition(tokens, capacity: int, nearly: int, each: int):
    """A mapInArrow function: tokenise, cut, and best-fit what a partition holds.  Only lengths are kept, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = tokens()
        ids, pieces, starts, lengths, sums = [], [], [], [], []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            many = getattr(encode, "many", None)
            found = many(batch.column("body")) if many else (encode(t or "") for some in parts(batch.column("body")) for t in some)
            for doc, data in zip(batch.column("doc_id").to_pylist(), found):
                step = 4 * capacity
                for number, at in enumerate(range(0, len(data), step)):
                    cut = data[at : at + step]
                    ids.append(doc)
                    pieces.append(number)
                    starts.append(at // 4)
                    lengths.append(len(cut) // 4)
                    sums.append(zlib.crc32(cut))
        if not ids:
            return
        place = best_fit(lengths, capacity)
        fill: dict[int, int] = {}
        for (number, offset), length in zip(place, lengths):
            fill[number] = fill.get(number, 0) + length
        names = {b: f"{part}-{b}" for b in fill}
        on = carried([(f, names[b]) for b, f in fill.items()], capacity, nearly, each)
        columns = [
            pa.array(ids, id_type), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
            pa.array([names[b] for b, _ in place]), pa.array([o for _, o in place], pa.int64()), pa.array([fill[b] for b, _ in place], pa.int64()),
            pa.array([part if names[b] in on else None for b, _ in place], pa.int64()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill", "grp"])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return run


def _merge(capacity: int, nearly: int, each: int):
    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["fill", "bin"], ascending=[False, True]).reset_index(drop=True)
        place = best_fit(bins["fill"].tolist(), capacity)
        lead: dict[int, str] = {}
        total: dict[str, int] = {}
        for (number, _), name, fill in zip(place, bins["bin"], bins["fill"]):
            into = lead.setdefault(number, name)
            total[into] = total.get(into, 0) + int(fill)
        on = carried([(f, b) for b, f in total.items()], capacity, nearly, each)
        into = [lead[number] for number, _ in place]
        return pd.DataFrame({
            "bin": bins["bin"], "into": into, "shift": [o for _, o in place], "fill": [total[b] for b in into], "grp": [key[0] if b in on else -1 for b in into],
        })

    return run


def pack(docs: DataFrame, tokens, capacity: int = CAPACITY, fan: int = FAN, nearly: int = NEARLY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's tokens into sequences of at most ``capacity``.

    ``tokens()`` is called in each task and gives a function from a text to its ids as little-endian unsigned 32-bit
    bytes; if that has an attribute ``many``, it is called with an Arrow array of texts instead and gives theirs in turn.  A document longer than capacity is cut into full pieces and a rest; nothing else is cut.

    1. Each partition packs its pieces by best fit, largest first, and emits its nearly full bins.
    2. Bins that are not nearly full become items of their fill.  Groups of ``fan`` partitions merge them by best fit,
       emit what is full or can't gain, and so on up a tree until one group is left.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece.  A null text is an empty one;
    a document whose tokens() are empty has no piece.  Null and repeated ids are rows of their own.  Empty tables give
    an empty result; other columns play no part.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    packed = checkpointed(source.mapInArrow(_pack_partition(tokens, capacity, nearly, fan * ROUNDS), PIECES.format(id=id_type)))
    bins = packed.filter("grp IS NOT NULL").groupBy("bin").agg(F.first("bin_fill").alias("fill"), F.first("grp").alias("grp"))
    top = packed.agg(F.max("grp")).first()[0]
    groups = (top or 0) + 1
    moved = bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"), "fill", "grp")
    while groups > 1:
        groups, rounds = -(-groups // fan), 0
        while fan**rounds < groups:
            rounds += 1
        live = moved.filter("grp >= 0").groupBy("into").agg(F.first("fill").alias("fill"), F.first("grp").alias("grp"))
        live = live.select(F.col("into").alias("bin"), "fill", F.floor(F.col("grp") / fan).alias("grp"))
        merged = live.groupBy("grp").applyInPandas(_merge(capacity, nearly, fan * rounds), "bin string, into string, shift long, fill long, grp long")
        merged = merged.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"), F.col("fill").alias("now"), F.col("grp").alias("to"))
        moved = moved.join(merged, "into", "left").select(
            "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            F.coalesce("now", "fill").alias("fill"), F.coalesce("to", F.lit(-1)).alias("grp"),
        )
        moved = checkpointed(moved)
    moved = moved.select(F.col("bin").alias("from"), "into", "shift")
    placed = packed.join(moved, F.col("bin") == F.col("from"), "left")
    part, number = F.split(F.coalesce("into", "bin"), "-")[0].cast("long"), F.split(F.coalesce("into", "bin"), "-")[1].cast("long")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.shiftleft(part, 32).bitwiseOR(number).alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


#: Words that a Python worker remembers from task to task, and letters of the longest that it does: some 50 MB.
REMEMBERED, REMEMBERED_LETTERS = 200_000, 40
#: Bytes of the texts that are tokenised together.
TOGETHER = 8 << 20
_memory: dict[str, WordBpe] = {}

#: Marks that may follow a word, and words that the tokenizer only lower-cases: letters below U+0180, U+0130 aside.
_MARKS = ".,!?:;%*#$&)"
_LATIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+$"


#: The letters that stand for octets in byte-level tokenizers: those that print for themselves, the others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SYMBOLS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Remembered(dict):
    """What make() gives for a key, remembered in two halves: a full one becomes the older, of which only what is used again stays."""

    def __init__(self, make, most: int, letters: int):
        self.make, self.most, self.letters, self.older = make, most, letters, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.letters:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def _by_size(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of TOGETHER bytes, or one text that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        yield texts.slice(at, to - at)
        at = to


class WordBpe:
    """Ids of the public tokenizers' lower-casing word BPE, as little-endian unsigned 32-bit bytes.

    This tokenizer drops white space and treats what stands between it by itself, so a text's ids are those of its
    chunks in turn, and chunks that many texts share are worked out once.  A chunk that is one word of Latin letters, perhaps with punctuation but no apostrophe after it, is the ids
    of the lower-cased word and of that tail; any other chunk, and any text that holds a special token's own string, goes
    through the whole tokenizer as it was loaded.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.octets_of = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.words = Remembered(self.word, REMEMBERED * 3 // 4, REMEMBERED_LETTERS)
        self.others = Remembered(self.whole, REMEMBERED // 4, REMEMBERED_LETTERS)
        self.odd = "[\x1c-\x1f\x85]|" + "|".join(map(re.escape, self.added))  # the first are white space to Python alone

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if not word:
            return b""
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(_SYMBOLS)
        return b"".join([self.octets_of[t.id] for t in self.model.tokenize(symbols)])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids; those of a chunk are worked out once for all texts of a run."""
        for run in _by_size(pc.fill_null(texts, "")):
            odd = pc.match_substring_regex(run, self.odd).to_numpy(zero_copy_only=False)
            split = pc.utf8_split_whitespace(run)  # an empty chunk at either end has no ids
            offsets = split.offsets.to_numpy()
            chunks = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            found = self.chunks(chunks.dictionary)
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            starts = np.cumsum(lengths) - lengths
            which = chunks.indices.to_numpy()
            sizes = lengths[which]
            ends = np.cumsum(sizes)
            ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(sizes.sum())]
            bounds = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                yield self.whole(run[i].as_py()) if odd[i] else ids[a:b].tobytes()

    def chunks(self, chunks: pa.Array) -> list[bytes]:
        """The ids of chunks that are all different."""
        core = pc.utf8_rtrim(chunks, characters=_MARKS)
        latin = pc.match_substring_regex(core, _LATIN).to_numpy(zero_copy_only=False)
        at, others = np.flatnonzero(latin), np.flatnonzero(~latin)
        out: list[bytes] = [b""] * len(chunks)
        low = pc.utf8_lower(core.take(pa.array(at))).dictionary_encode()
        tail = pc.replace_substring_regex(chunks.take(pa.array(at)), f"^[^{_MARKS}]+", "").dictionary_encode()
        words, tails = (list(map(self.words.__getitem__, x.dictionary.to_pylist())) for x in (low, tail))
        for i, a, b in zip(at.tolist(), low.indices.to_pylist(), tail.indices.to_pylist()):
            out[i] = words[a] + tails[b]
        for i, chunk in zip(others.tolist(), chunks.take(pa.array(others)).to_pylist()):
            out[i] = self.others[chunk] if chunk else b""
        return out


def word_bpe_tokens(path: str | None = None):
    """tokens() for pack(): each document's ids by word_bpe_49k.json, or the like file at path, followed by id 0."""

    def make():
        import public_tokenizers

        file = path or public_tokenizers.path("word_bpe_49k.json")
        if file not in _memory:
            _memory[file] = WordBpe(file)
        encoder = _memory[file]

        def encode(text: str) -> bytes:
            return encoder.encode(text) + b"\0\0\0\0"

        encode.many = lambda texts: (ids + b"\0\0\0\0" for ids in encoder.encode_all(texts))
        return encode

    return make


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe_tokens())
