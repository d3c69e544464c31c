"""Spelling variant grouping: near words by pivotal grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, parts, ship, table

#: Code points in the shortest word, occurrences of the rarest one, and how often more a form occurs than its variant.
LEAST, SEEN, FACTOR = 7, 2, 10
#: One occurrence group of this many has a letter deleted, by the contract's checksum.
DAMAGE = 31
#: Letters: a-z and U+00C0 to U+00FF.  So there are at most ALPHABET ** 2 grams, whatever the number of words.
ALPHABET = 26 + 64
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
#: Letters of the intact side from which on a key needs none of the other side.
ENOUGH = 6
#: Letters up to which words have pivots; from here on halves are keys, whatever the letters.  A prefix is so bounded.
LONG = 64
#: Letters of keyed words in a batch.
KEYED = 1 << 23
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def damaged(doc_id: int | None, run: str) -> str:
    """The run as the document has it; where DAMAGE divides the checksum of id and run, without one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), summed up within a task; shorter runs can't give a word and are never looked at."""
    counts: Counter[str] = Counter()

    def handed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        ids = iter(batch.column("id").to_pylist())
        for texts in parts(batch.column("body")):
            for text in texts:
                doc_id = next(ids)
                for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes: A-Z only
                    word = damaged(doc_id, run)
                    if len(word) >= LEAST:
                        counts[word] += n
                if len(counts) > HELD:
                    yield handed_on()
    yield handed_on()


def prefix(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """The word's first three grams as (rank, place), rarest first, with all others of the third one's rank.

    An edit touches two grams at most, so of three one stays; equal grams go together, for their order is open.
    """
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    return [g for g in grams if g[0] <= grams[2][0]]


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of two grams of the prefix that share no letter, of least ranks together; the first stands left.

    Dynamic programming from left to right: the best gram that ends before a place, and the best pair so far.
    """
    rank = {place: r for r, place in grams}
    one: dict[int, tuple[int, int]] = {}  # place -> the rarest gram at or before it
    best, pair = None, None
    so_far = None
    for place in range(max(rank) + 1):
        if place in rank:
            left = one.get(place - 2)
            if left and (best is None or left[0] + rank[place] < best):
                best, pair = left[0] + rank[place], (left[1], place)
            if so_far is None or rank[place] < so_far[0]:
                so_far = (rank[place], place)
        if so_far:
            one[place] = so_far
    return pair


def _keys(word: str, place: int, left: bool) -> Iterator[str]:
    """Keys of a word in which the gram at a place and all letters on its left (or right) are intact.

    Two words with one edit between them, on the other side of that gram, have such a side in common, the gram standing
    equally far from that end of both.  If the side is short, one half of the other side is intact too: that half is part of
    the key, with the length m of the shorter of the two other sides; a word doesn't know whether it is the shorter one.
    """
    same, rest = (word[: place + 2], word[place + 2 :]) if left else (word[place:], word[:place])
    if len(same) >= ENOUGH:
        yield f"{left}|{same}"
        return
    for m in range(max(len(rest) - 1, 0), len(rest) + 1):
        yield f"{left}|{same}|{m}|a{rest[: m // 2]}"
        yield f"{left}|{same}|{m}|b{rest[len(rest) - (m - m // 2) :]}"


def _halves(word: str) -> Iterator[str]:
    """An edit leaves one half of a word intact; m is the length of the shorter word of the two."""
    for m in (len(word) - 1, len(word)):
        yield f"{m}|a{word[: m // 2]}"
        yield f"{m}|b{word[len(word) - (m - m // 2) :]}"


def pivot_keys(word: str, ranks: dict[str, int]) -> tuple[int, list[str]]:
    """(last rank of the prefix, keys of the pivots).

    An edit before the second pivot leaves that one and all on its right intact; any other leaves the first and all on its
    left intact.  Two near words of over LONG letters, or of LONG and one more, meet by halves.
    """
    halves = list(_halves(word)) if len(word) >= LONG else []
    if len(word) > LONG:
        return 0, halves
    grams = prefix(word, ranks)
    first, second = pivots(grams)
    return grams[-1][0], [*_keys(word, first, True), *_keys(word, second, False), *halves]


def prefix_keys(word: str, ranks: dict[str, int]) -> tuple[int, list[str]]:
    """(last rank of the prefix, keys of all its grams, either side intact)."""
    halves = list(_halves(word)) if len(word) >= LONG else []
    if len(word) > LONG:
        return 0, halves
    grams = prefix(word, ranks)
    return grams[-1][0], [*(k for _, place in grams for left in (True, False) for k in _keys(word, place, left)), *halves]


_KEYED = "key long, word string, n long, last int"


def _keyed(words: DataFrame, keys, ranks: dict[str, int], role: str) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        def keyed(some: pa.RecordBatch, found: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            of = np.repeat(np.arange(len(found)), [len(k) for _, k in found])
            key = np.fromiter((xxh64_intdigest(k) for _, ks in found for k in ks), np.uint64, len(of)).view(np.int64)
            last, taken = np.array([r for r, _ in found], dtype=np.int32)[of], pa.array(of)
            return pa.RecordBatch.from_arrays([pa.array(key), some.column("word").take(taken), some.column("n").take(taken), pa.array(last)], ["key", "word", "n", "last"])

        for batch in batches:
            start, found, size = 0, [], 0
            for i, word in enumerate(batch.column("word").to_pylist()):
                found.append(keys(word, ranks))
                size += len(word) * len(found[-1][1])
                if size >= KEYED or i + 1 == batch.num_rows:
                    yield keyed(batch.slice(start, i + 1 - start), found)
                    start, found, size = i + 1, [], 0

    return words.mapInArrow(emit, _KEYED).select(*(F.col(c).alias(f"{role}_{c}") for c in ("key", "word", "n", "last")))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur SEEN times or more."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    return source.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each gram by the words of up to LONG letters that hold it, rarest first: ALPHABET ** 2 at most."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    rows = words.filter(F.length("word") <= LONG).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {gram: rank for rank, (_, gram) in enumerate(sorted((r.n, r.gram) for r in rows))}


def near_pairs(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(a, a_n, b, b_n), a < b: the pairs of words (word, n) that one edit tells apart, each once.

    The prefix that ends at the rarer rank belongs to the word whose pivots are looked for in the other's prefix: an edit
    leaves a pivot of it intact, and the other word, which holds that gram, has it in its prefix.  Keys are hashed; that
    and chance meetings are settled by the edit distance, in the join itself.
    """
    pivot, other = _keyed(words, pivot_keys, ranks, "p"), _keyed(words, prefix_keys, ranks, "o")
    apart = F.length("p_word") - F.length("o_word")
    near = (
        (F.col("p_key") == F.col("o_key")) & (F.col("p_last") <= F.col("o_last")) & apart.between(-1, 1)
        & (F.col("p_word") != F.col("o_word")) & (F.levenshtein("p_word", "o_word", 1) == 1)
    )
    first = F.col("p_word") < F.col("o_word")
    met = pivot.join(other, near).select(
        F.when(first, F.col("p_word")).otherwise(F.col("o_word")).alias("a"), F.when(first, F.col("p_n")).otherwise(F.col("o_n")).alias("a_n"),
        F.when(first, F.col("o_word")).otherwise(F.col("p_word")).alias("b"), F.when(first, F.col("o_n")).otherwise(F.col("p_n")).alias("b_n"),
    )
    return met.distinct()


def roots(links: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(word, root) of links (word, form): where each word's forms lead in the end, by pointer doubling.

    A form occurs FACTOR times as often as its word, so chains have no cycle and are short: twelve rounds would follow
    4,096 steps.  A word is near to a few thousand others at most, as the alphabet is bounded; so is a form's group.
    """
    to = checkpointed(links.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        step = to.select(F.col("word").alias("via"), F.col("root").alias("further"))
        found = to.join(step, F.col("root") == F.col("via"), "left")
        found = checkpointed(found.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if found.filter("moved").isEmpty():
            break
        to = found.drop("moved")
    return found.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words that are likely misspelt, with the form that they vary.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case, less a letter in the share of
    (document, run) that the checksum names; it has LEAST letters or more and occurs SEEN times or more in all.  Two words
    are near if one letter inserted, deleted or replaced tells them apart.  A word's form is its near word of most
    occurrences (of ties the smallest in code-point order) if these are FACTOR times its own or more.

    Returns word, form, root (where forms lead in the end; the word itself without one), n, n_near, form_n.  Null and empty
    texts hold no words; a null id counts as one without digits; rows that repeat count as often; words without a near one
    have n_near 0.  Texts of any length are read whole.  An empty table gives an empty result; other columns play no part.
    """
    ship(docs.sparkSession)
    words = checkpointed(vocabulary(docs, id_col, text_col))
    pairs = near_pairs(words, gram_ranks(words))
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    sided = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = sided.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    known = words.join(best, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), formed.alias("f"))
    known = checkpointed(known.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")))
    end = roots(known.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    out = known.join(end, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS tagged
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(tagged), 2), lambda i: ('0x' || substr(hex(encode(tagged)), i::INT, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less, left(word, i - 1) || '*' || substr(word, i + 1) AS hole
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.less = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.less = v.word
), best AS MATERIALIZED (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n,
         CASE WHEN top >= 10 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.other_n = best.top) END AS form
  FROM v LEFT JOIN best ON best.word = v.word
), walk AS (
  SELECT word, word AS at FROM v UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.at WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk ON walk.word = f.word JOIN formed last ON last.word = walk.at AND last.form IS NULL
"""
