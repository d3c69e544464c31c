"""Fill-in-middle transformation: cuts are located on a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import ship, table

#: Character classes: three bits, so three levels of a matrix.
NEWLINE, BLANK, STOP, MARK, DIGIT, UPPER, LOWER, OTHER = range(8)
BITS = 3
#: The classes that end a unit; what follows the last one is a unit too.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK), "character": tuple(range(8))}
#: Code points that share a matrix; a longer text has one of its own.
SHARED = 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"


def _class_of(c: str) -> int:
    if c == "\n":
        return NEWLINE
    if c in " \t\v\f\r":
        return BLANK
    if c in ".!?":
        return STOP
    return DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.islower() else MARK


_CLASSES = np.array([_class_of(chr(c)) for c in range(128)] + [OTHER], dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    """The class of each code point; those beyond ASCII are OTHER."""
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]


class WaveletMatrix:
    """Rank over a sequence of small numbers: a level a bit, from the highest; each level hands its zeros on before its ones."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.levels = []
        for b in reversed(range(bits)):
            ones = (values >> b & 1).astype(bool)
            packed = np.zeros(len(values) // 64 * 8 + 8, dtype=np.uint8)
            packed[: (len(values) + 7) // 8] = np.packbits(ones, bitorder="little")
            words = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((b, words, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, ends: np.ndarray) -> np.ndarray:
        """How often the value stands before each of the places ``ends``."""
        at, start = ends, np.zeros(1, dtype=np.int64)
        for b, words, before, zeros in self.levels:
            at, start = (self._ones(words, before, x) for x in (at, start)) if value >> b & 1 else (x - self._ones(words, before, x) for x in (at, start))
            if value >> b & 1:
                at, start = at + zeros, start + zeros
        return at - start

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        word, rest = ends >> 6, (ends & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def boundaries(self, ends: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many code points before each place end a unit."""
        return sum(self.rank(c, places) for c in ends)


def units_and_cuts(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, low, high) of each text: its units, and the code points before the two cuts.

    The cuts stand after first % (n + 1) and second % (n + 1) units, the smaller first.  All texts are in one matrix, so
    that each step of the bisection is a few array operations.
    """
    ends = UNITS[unit]
    kinds = classes("".join(texts))
    matrix = WaveletMatrix(kinds)
    stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    base, closed = matrix.boundaries(ends, start), matrix.boundaries(ends, stop)
    closed -= base
    open_end = (stop > start) & ~np.isin(kinds[np.maximum(stop - 1, 0)] if len(kinds) else np.zeros(len(texts)), ends)
    n = closed + open_end

    def place(k: np.ndarray) -> np.ndarray:
        """Code points before the end of unit k: the least place with k boundaries before it, found by bisection on ranks."""
        low, high = start.copy(), stop.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = matrix.boundaries(ends, middle) - base >= k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low - start

    a, b = first % (n + 1), second % (n + 1)
    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of SHARED code points together at most, or one longer text, with the place of the first."""
    at, group, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        if group and size + len(text) > SHARED:
            yield at, group
            at, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield at, group


def cuts(text: Column, first: Column, second: Column, unit: str = "line") -> Column:
    """Struct of n, low and high of units_and_cuts()."""

    def located(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for body, a, b in batches:
            a, b, out = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), [(np.zeros(0, np.int64),) * 3]
            for at, texts in _groups(body):
                out.append(units_and_cuts(texts, a[at : at + len(texts)], b[at : at + len(texts)], unit))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["n", "low", "high"])

    return F.arrow_udf(located, "struct<n long, low long, high long>")(text, first, second)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of."""
    piece = F.split(output, SENTINELS, -1)
    psm, spm = F.concat(piece[1], piece[3], piece[2]), F.concat(piece[2], piece[3], piece[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Each text, cut into units, as prefix, suffix and middle with marks before them.

    Two hashes of seed and id choose the cuts among the n + 1 places between units, a third whether the text is
    transformed at all (``rate`` in a hundred), a fourth whether the suffix comes first (spm, ``spm_rate`` in a hundred) or
    the prefix (psm).  A text that is empty or holds a mark stays plain.

    Returns id, n, form, prefix_chars, middle_chars (null if plain), output and text, a row for each row of docs and in one
    pass without a shuffle.  Null text counts as empty; a null id as an id without digits, so that all null ids draw alike;
    rows that repeat give rows that repeat.  Texts of any length are cut whole.  An empty table gives an empty result; other
    columns play no part.
    """
    ship(docs.sparkSession)
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), own), 256)
    h = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"), *(x.alias(f"h{i}") for i, x in enumerate(h)))
    rows = rows.withColumn("cut", cuts(F.col("body"), F.col("h0"), F.col("h1"), unit))
    plain = (F.col("body") == "") | F.col("body").rlike(SENTINELS) | (F.col("h2") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h3") % 100 < spm_rate, "spm").otherwise("psm"))
    low, high = F.col("cut.low"), F.col("cut.high")
    prefix, middle, suffix = F.substr("body", F.lit(1), low.cast("int")), F.substr("body", (low + 1).cast("int"), (high - low).cast("int")), F.substr("body", (high + 1).cast("int"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col),
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, low).alias("prefix_chars"),
        F.when(moved, high - low).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body")).alias("output"),
        F.col("body").alias(text_col),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS d FROM documents
), h AS (
  SELECT doc_id, body, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, body, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE body END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
