"""LM scoring: subword lattice likelihood over an existing piece vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, parts, ship, table
from ablatrix.llm.language import in_fold

#: Most frequent words whose figures are broadcast; every other word is looked up by a shuffled join.
HEAD_WORDS = 200_000
#: Weight of each of the 256 single bytes that stand in where no piece fits, and of a text's end.
BYTE_WEIGHT, END_WEIGHT = 1e-7, 1e-3
#: What the vocabulary's own scores weigh in the adapted weights, beside the corpus's counts.
PRIOR_SHARE = 0.02
#: Words up to this many bytes are scored together, by length; longer ones one by one.
TOGETHER = 48
#: Chances are kept in plain numbers, times SCALE for each byte, so that no word of TOGETHER bytes leaves a double's range.
SCALE, LEAST, MOST = 1e3, 1e-280, 1e280
#: A byte value that stands behind each word and that no piece has.
_STOP = 256


@dataclass
class Pieces:
    """A vocabulary of byte strings, a word's first byte being a space, and the log weight of each."""

    names: list[bytes]
    weights: np.ndarray
    end: float

    def __post_init__(self):
        self.longest = max(map(len, self.names))
        self.number = {name: i for i, name in enumerate(self.names)}
        self.sizes = np.array([len(name) for name in self.names])
        self._tree()

    def _tree(self) -> None:
        """The pieces as a tree in three arrays: a node's child by a byte stands at base[node] + byte, and names the node as its parent."""
        children: dict[bytes, set[int]] = {b"": set()}
        for name in self.names:
            for n in range(len(name)):
                children.setdefault(name[:n], set()).add(name[n])
        size = 2 * sum(map(len, children.values())) + 1024
        base, parent, piece, taken = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), bytearray(size)
        at, taken[0], free = {b"": 0}, 1, 1
        for prefix in sorted(children, key=len):  # parents first
            some = sorted(children[prefix])
            while taken[free]:
                free += 1
            where = max(free - some[0], 0)
            while any(taken[where + byte] for byte in some):
                where = taken.find(0, where + some[0] + 1) - some[0]
            base[at[prefix]] = where
            for byte in some:
                at[prefix + bytes([byte])] = where + byte
                parent[where + byte], taken[where + byte] = at[prefix], 1
        for i, name in enumerate(self.names):
            piece[at[name]] = i
        self.tree = base, parent, piece

    def weighted(self, weights: np.ndarray, end: float) -> Pieces:
        """The same pieces with other log weights."""
        other = copy(self)
        other.weights, other.end = weights, end
        return other

    def arcs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the pieces in all words, by their start's place in its word."""
        base, parent, piece = self.tree
        start = at = np.arange(len(words.data))
        node = np.zeros(len(at), np.int32)
        found = [(at[:0], at[:0], piece[:0])]
        while len(start):
            child = base[node] + words.data[at]
            on = parent[child] == node
            start, at, node = start[on], at[on] + 1, child[on]
            which = piece[node]
            hit = which >= 0
            found.append((start[hit], at[hit], which[hit]))
        start, end, which = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(words.place[start], kind="stable")
        return start[order], end[order], which[order]

    def forward(self, words: Words, arcs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The chance of what stands before each place of a word, over all segmentations, times SCALE for each byte."""
        start, end, piece = arcs
        through = (np.exp(self.weights) * SCALE**self.sizes)[piece]
        alpha = np.zeros(len(words.data))
        alpha[words.first] = 1
        with np.errstate(over="ignore", invalid="ignore"):  # such words are worked out alone
            for some in _steps(words.place[start]):  # arcs of one step have all different ends
                alpha[end[some]] += alpha[start[some]] * through[some]
        return alpha

    def expected(self, data: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add to into how often each piece is expected, over all segmentations, in counts[r] times row r, which begins with a space."""
        self.expect([row.tobytes()[1:] for row in data], counts, into)

    def expect(self, some: list[bytes], counts: np.ndarray, into: np.ndarray) -> None:
        """Add to into how often each piece is expected, over all segmentations, in counts[r] times word r; or so for each row of both."""
        counts, into = np.atleast_2d(counts), np.atleast_2d(into)
        rows, words, long = _apart(some)
        arcs = start, end, piece = self.arcs(words)
        alpha = self.forward(words, arcs)
        whole = alpha[words.last]
        fit = (whole > LEAST) & (whole < MOST)
        long += rows[~fit].tolist()
        through = (np.exp(self.weights) * SCALE**self.sizes)[piece]
        beta = np.zeros(len(alpha))
        beta[words.last] = 1
        back = np.argsort(words.place[end], kind="stable")
        for step in reversed(list(_steps(words.place[end[back]]))):
            step = back[step]
            beta[start[step]] += through[step] * beta[end[step]]
        share = np.repeat(np.where(fit, 1 / np.where(fit, whole, 1), 0), words.last - words.first + 1)
        once, word = alpha[start] * through * beta[end] * share[start], np.repeat(rows, words.last - words.first + 1)[start]
        for n, line in zip(counts, into):
            line += np.bincount(piece, weights=once * n[word], minlength=len(line))
        for r in long:
            for n, line in zip(counts, into):
                self.expected_alone(b" " + some[r], n[r], line)

    def _into(self, word: bytes) -> Iterator[list[tuple[int, int]]]:
        """For each end in one word, the (start, piece) of the pieces that end there."""
        for j in range(1, len(word) + 1):
            yield [(i, n) for i in range(max(0, j - self.longest), j) if (n := self.number.get(word[i:j])) is not None]

    def alone(self, word: bytes) -> float:
        """The log probability of one long word, all segmentations summed in log space."""
        alpha = [0.0]
        for ending in self._into(word):
            alpha.append(_log_sum([alpha[i] + self.weights[n] for i, n in ending]))
        return alpha[-1]

    def expected_alone(self, word: bytes, count: float, into: np.ndarray) -> None:
        """expected() of one long word."""
        ends, alpha = list(self._into(word)), [0.0]
        for ending in ends:
            alpha.append(_log_sum([alpha[i] + self.weights[n] for i, n in ending]))
        onward: list[list[float]] = [[] for _ in alpha]
        onward[-1].append(0.0)
        for j in range(len(word), 0, -1):
            if not onward[j]:
                continue  # no piece leads from here to the word's end
            beta = _log_sum(onward[j])
            for i, n in ends[j - 1]:
                through = self.weights[n] + beta
                onward[i].append(through)
                into[n] += math.exp(alpha[i] + through - alpha[-1]) * count

    def log10(self, some: list[bytes], *others: Pieces) -> np.ndarray:
        """log10 of each word's probability, summed over all its segmentations; a row more for each of others' weights."""
        models = (self, *others)
        out = np.empty((len(models), len(some)))
        rows, words, long = _apart(some)
        arcs = self.arcs(words)
        for line, model in zip(out, models):
            whole = model.forward(words, arcs)[words.last]
            fit = (whole > LEAST) & (whole < MOST)
            line[rows] = np.log(np.where(fit, whole, 1)) - (words.last - words.first) * math.log(SCALE)
            for r in (*rows[~fit].tolist(), *long):
                line[r] = model.alone(b" " + some[r])
        return (out if others else out[0]) / math.log(10)


def _log_sum(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top


@dataclass
class Words:
    """Words end to end, each with a space before it and a stop behind: its bytes, their places in it, its first and its stop."""

    data: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _apart(some: list[bytes]) -> tuple[np.ndarray, Words, list[int]]:
    """(rows, words) of the words of up to TOGETHER bytes, and the rows of the longer ones."""
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    rows = np.flatnonzero(sizes <= TOGETHER)
    short = some if len(rows) == len(some) else [some[r] for r in rows.tolist()]
    last = np.cumsum(sizes[rows] + 2) - 1
    first = last - sizes[rows] - 1
    data = np.frombuffer(b"".join([b" %b " % w for w in short]), np.uint8).astype(np.int32)
    data[last] = _STOP
    place = (np.arange(len(data)) - np.repeat(first, sizes[rows] + 2)).astype(np.uint8)
    return rows, Words(data, place, first, last), np.flatnonzero(sizes > TOGETHER).tolist()


def _steps(places: np.ndarray) -> Iterator[slice]:
    """Slices of equal places, which are in order."""
    edges = np.searchsorted(places, np.arange(TOGETHER + 3))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if a < b:
            yield slice(a, b)


def load_pieces(path: str | None = None) -> Pieces:
    """The pieces of a sentencepiece vocabulary and their scores as log weights.

    A unigram vocabulary's scores are log probabilities.  A BPE vocabulary's are minus a piece's rank; they become
    weights by Zipf's law.  Every single byte is a piece too, so that any text has a segmentation.
    """
    import public_tokenizers
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    scores: dict[bytes, float] = {}
    for i in range(vocabulary.get_piece_size()):
        if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i)):
            name = vocabulary.id_to_piece(i).replace("▁", " ").encode()
            if name.rfind(b" ") <= 0:
                scores[name] = vocabulary.get_score(i)
    values = np.array(list(scores.values()))
    ranked = len(values) > 1 and np.array_equal(values, np.round(values))
    weights = 1 / (10 - values) if ranked else np.exp(values)
    weights = dict(zip(scores, weights / weights.sum()))
    for byte in range(256):
        weights[bytes([byte])] = weights.get(bytes([byte]), 0) + BYTE_WEIGHT
    return Pieces(list(weights), np.log(np.array(list(weights.values()))), math.log(END_WEIGHT))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition, n from its training rows alone."""
    train, other = Counter(), set()
    for batch in batches:
        for held, text in zip(batch.column("held_out").to_pylist(), batch.column("body").to_pylist()):
            if held:
                other.update(_words(text))
            else:
                train.update(_words(text))
    names = [*train, *(w for w in other if w not in train)]
    n = [*train.values(), *([0] * (len(names) - len(train)))]
    for at in range(0, len(names), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 20_000], pa.binary()), pa.array(n[at : at + 20_000], pa.int64())], ["word", "c"])


def _expect(shared):
    """(piece, n, kinds): how often each piece is expected in all training words, and in each different one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        into = np.zeros((2, len(pieces.names)))
        for batch in batches:
            for some in _slices(batch):
                counts = some.column("c").to_numpy(zero_copy_only=False).astype(float)
                pieces.expect(some.column("word").to_pylist(), np.stack([counts, np.ones(len(counts))]), into)
        some = np.flatnonzero(into[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(into[0][some]), pa.array(into[1][some])], ["piece", "n", "kinds"])

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 4000):
        yield batch.slice(at, 4000)


@dataclass
class Open:
    """Words by their discounted counts in the training rows; what the discounts leave is spelled by the lattice."""

    tokens: int
    discount: float
    left: float

    @classmethod
    def of(cls, tokens: int, kinds: int, once: int, twice: int) -> Open:
        """By the numbers of tokens, of different ones, and of those that occur once and twice (absolute discounting)."""
        discount = (once + 1) / (once + 2 * twice + 2)
        return cls(tokens, discount, discount * kinds / tokens if tokens else 1.0)

    def log10(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of the chance of tokens of these counts that the lattice gives the chance 10 ** spelled."""
        known = np.where(counts > 0, np.maximum(counts - self.discount, 0) / max(self.tokens, 1), 0)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(known), math.log(self.left) + spelled * math.log(10)) / math.log(10)


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, counted, names = shared.value
        models = [own.weighted(*weights[name]) for name in names]
        for whole in batches:
            for batch in _slices(whole):
                values = np.atleast_2d(models[0].log10(batch.column("word").to_pylist(), *models[1:]))
                if "open_score" in names:
                    at = names.index("open_score")
                    values[at] = counted.log10(batch.column("c").to_numpy(zero_copy_only=False), values[at])
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), *map(pa.array, values)], ["word", "c", *(f"tail_{x}" for x in names)])

    return run


#: The lattice's scores that lattice_scores can give.
SCORES = ("score", "adapted_score", "open_score")


def _score(shared):
    """A row for each document, with what its frequent words sum to, and one for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, figures, known, end, ends_known = shared.value
        for batch in batches:
            keys, n = batch.column("key").to_pylist(), batch.num_rows
            own: list[list] = [[] for _ in range(2 + len(figures))]
            tail_key, tail_word, tail_n = [], [], []
            for key, text in zip(keys, (t for some in parts(batch.column("body")) for t in some)):
                words = _words(text)
                at = np.array([index.get(w, -1) for w in words], dtype=np.int64)
                seen = at[at >= 0]
                if len(seen) < len(words):
                    rest = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                    tail_key += [key] * len(rest)
                    tail_word += rest
                    tail_n += rest.values()
                own[0].append(len(words) + 1)
                own[1].append(int(known[seen].sum()) + ends_known)
                for column, figure, ends in zip(own[2:], figures, end):
                    column.append(float(figure[seen].sum()) + ends)
            columns = ["word", "key", "id", "held_out", "n_tokens", "n_known", *(f"own_{i}" for i in range(len(figures))), "n"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b" %d" % k for k in keys], pa.binary()), batch.column("key"), batch.column("id"), batch.column("held_out"),
                    pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), *(pa.array(x, pa.float64()) for x in own[2:]), pa.nulls(n, pa.int64()),
                ],
                columns,
            )
            for a in range(0, len(tail_key), 20_000):
                part = tail_key[a : a + 20_000]
                nothing = [pa.nulls(len(part), t) for t in (batch.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), *(pa.float64() for _ in figures))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tail_word[a : a + 20_000], pa.binary()), pa.array(part, pa.int64()), *nothing, pa.array(tail_n[a : a + 20_000], pa.int64())], columns
                )

    return run


def _least_count(words: DataFrame, most: int) -> int:
    """The smallest count that ``most`` words or fewer have, to a sixteenth of a power of two: only that many bins meet."""
    bins = words.filter("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    total, least = 0, 1 << 62
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        total += r.n
        if total > most:
            break
        least = r.least
    return least


def _fitted(own: Pieces, uses: np.ndarray, ends: float) -> tuple[np.ndarray, float]:
    """Log weights of the pieces and of the end by expected uses, beside which the vocabulary's scores keep a small share."""
    total = uses.sum() + ends
    share = PRIOR_SHARE if total else 1.0
    weights = np.log((1 - share) * uses / max(total, 1) + share * np.exp(own.weights))
    return weights, math.log(((1 - share) * ends / max(total, 1)) + share * math.exp(own.end))


def lattice_scores(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", pieces: str | None = None, head_words: int = HEAD_WORDS, scores: tuple[str, ...] = SCORES
) -> DataFrame:
    """log10 probabilities of every whole text, learned from the rows where train holds.

    Tokens are the text's words, A-Z in lower case, and one end.  base_score adds their smoothed log frequencies.
    score is the subword lattice's: a text is a sequence of pieces and an end, its probability the sum over all
    segmentations, computed word by word, which is exact as no piece spans a space.  The vocabulary's own
    scores weight the segmentations.  adapted_score is the same with weights fitted to the training rows: one pass over
    the words' counts gives the expected uses of each piece over all segmentations, beside which the vocabulary's scores
    keep a small share.  open_score is a lattice too, with one more way through each word that the training rows have:
    the word as a whole, by its discounted count.  What the discounts leave goes to the ways by pieces, whose weights are
    fitted to each different training word once, as it is new words that need them, and sum to one.

    Words are counted over all documents.  A document's frequent words (head_words at most, broadcast with their
    figures) are summed where it is read; each of its other words is one row that meets its count by a shuffled join.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, and those of SCORES that are asked for.  A null or
    wordless text is an end alone.  Ids may be null or repeat, each row is scored; with no training rows counts are zero
    and the other scores are near score; words of any length are scored; an empty table gives an empty result; other
    columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), (~train).alias("held_out"))
    words = checkpointed(source.select("body", "held_out").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    ends = source.filter(~F.col("held_out")).count()
    n, v, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n, v, once, twice = n + ends, v + (ends > 0), once + (ends == 1), twice + (ends == 2)

    own = load_pieces(pieces)
    weights = {"score": (own.weights, own.end)}
    if set(scores) - {"score"}:
        counted = words.filter("c > 0").mapInArrow(_expect(spark.sparkContext.broadcast(own)), "piece int, n double, kinds double")
        uses = np.zeros((2, len(own.names)))
        for piece, used, kinds in counted.groupBy("piece").agg(F.sum("n"), F.sum("kinds")).collect():
            uses[:, piece] = used, kinds
        weights["adapted_score"] = _fitted(own, uses[0], ends)
        spelling, end = _fitted(own, uses[1], float(ends > 0))
        whole = math.log(np.exp(spelling).sum() + math.exp(end))
        weights["open_score"] = spelling - whole, end - whole
    counts = Open.of(n, v, once, twice)
    weigh = _weigh(spark.sparkContext.broadcast((own, {x: weights[x] for x in scores}, counts, scores)))
    weighed = checkpointed(words.mapInArrow(weigh, ", ".join(["word binary, c long", *(f"tail_{x} double" for x in scores)])))

    least = _least_count(words, head_words)
    head = weighed.filter(F.col("c") >= least).toPandas()
    smooth = lambda c: np.log10((c + 1) / (n + v + 1))
    c = head["c"].to_numpy(dtype=float)
    ending = {x: weights[x][1] / math.log(10) for x in scores}
    if "open_score" in scores:  # by pieces a token begins with a space or is an end
        starts = sum(math.exp(w) for name, w in zip(own.names, weights["open_score"][0]) if name.startswith(b" "))
        end = math.exp(weights["open_score"][1])
        ending["open_score"] = float(counts.log10(np.array(ends), np.log10(end / (starts + end))))
    figures = (smooth(c), *(head[f"tail_{x}"].to_numpy(dtype=float) for x in scores))
    shared = spark.sparkContext.broadcast(({bytes(w): i for i, w in enumerate(head["word"])}, figures, c > 0, (float(smooth(ends)), *ending.values()), int(ends > 0)))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"word binary, key long, id {id_type}, held_out boolean, n_tokens long, n_known long, {', '.join(f'own_{i} double' for i in range(len(figures)))}, n long"
    found = source.withColumn("key", F.monotonically_increasing_id()).mapInArrow(_score(shared), schema)
    joined = found.join(weighed.filter(F.col("c") < least), "word", "left")
    is_tail = F.col("n").isNotNull()
    log_base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    total = lambda tail, own_figure: F.sum(F.when(is_tail, F.col("n") * tail).otherwise(F.col(own_figure)))
    out = joined.groupBy("key").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_tail, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        total(log_base, "own_0").alias("base_score"),
        *(total(F.col(f"tail_{x}"), f"own_{i}").alias(x) for i, x in enumerate(scores, start=1)),
    )
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", *scores)


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the open lattice's; adapted_score is that of the pieces alone."""
    scored = lattice_scores(table(spark, sf_dir, "documents"), ~in_fold(7, 2), scores=("open_score", "adapted_score"))
    return scored.withColumnRenamed("open_score", "score")
