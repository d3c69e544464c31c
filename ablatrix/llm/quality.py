"""Quality classifier: co-training of a text view and a page-metadata view."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, parts, ship, table

#: The classifiers are fitted on about FIT_ROWS labelled rows at most, half of them of either class where there are so
#: many.  Pseudo-labels are looked for among all other rows.
FIT_ROWS = 4_000
#: Rounds of co-training; rows that a view may label in each, for each class; and how sure it has to be.
ROUNDS, EXCHANGED, SURE = 2, 500, 0.95
#: Rows whose combined chance of good quality is below it are rejected.
THRESHOLD = 0.5
#: Shapes of the text view; places that its words are hashed to, and those of its n-grams of GRAM bytes after these.
SHAPES, WORD_PLACES, GRAM_PLACES, GRAM = 14, 1 << 14, 1 << 12, 4
CONTENT = WORD_PLACES + GRAM_PLACES
#: Hashed one-hot places of the metadata view, which has two more.
PLACES = 64


def _is(some: bytes | range) -> np.ndarray:
    """Which byte values are among some."""
    return np.isin(np.arange(256), list(some))


_SPACE, _UPPER, _LOWER, _DIGIT = _is(b" \t\n\v\f\r"), _is(range(65, 91)), _is(range(97, 123)), _is(range(48, 58))
_LETTER = _UPPER | _LOWER | _is(range(128, 256))  # what isn't ASCII counts as a letter
_SYMBOL = ~(_LETTER | _DIGIT)
_STOPS = _is(b".,;:!?")
#: Bits of each byte value, so that those of a word's bytes, or-ed, say what the word has; other: what a plain word has not.
_HAS_UPPER, _HAS_LOWER, _HAS_ALNUM, _HAS_OTHER = 1, 2, 4, 8
_BITS = (_UPPER * _HAS_UPPER + _LOWER * _HAS_LOWER + (_LETTER | _DIGIT) * _HAS_ALNUM + ~(_LETTER | _is(b"'-") | _SPACE) * _HAS_OTHER).astype(np.uint8)
#: Bytes of texts that features are worked out for side by side, and texts whose n-grams are counted so.
SIDE_BY_SIDE, COUNTED = 1 << 18, 16
#: Logarithms of one more than the usual counts.
_LOGS = np.log1p(np.arange(1 << 12))


@dataclass
class Rows:
    """Features of some rows: dense ones, and for each row the places of its content and their values, end to end."""

    dense: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def take(self, at: np.ndarray) -> Rows:
        starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        at = np.flatnonzero(at) if at.dtype == bool else at
        some = lambda x: np.concatenate([x[:0], *(x[starts[i] : starts[i + 1]] for i in at.tolist())])
        return Rows(self.dense[at], self.sizes[at], some(self.places), some(self.values))

    def join(self, *others: Rows) -> Rows:
        return Rows(*(np.concatenate([getattr(r, f) for r in (self, *others)]) for f in ("dense", "sizes", "places", "values")))

    @staticmethod
    def of(x: np.ndarray | Rows) -> Rows:
        return x if isinstance(x, Rows) else Rows(x, np.zeros(len(x), np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))


def text_features(text: str | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """(shapes, places, values) of a text.

    Shapes are shares of words, symbols, capitals, repeats and lines; lengths enter by their logarithm.  The places are
    those of its words and of its n-grams, A-Z in lower case, by hash; a value is the logarithm of one more than the
    count, and a text's values have length one.
    """
    rows = text_rows([text])
    return rows.dense[0].tolist(), rows.places, rows.values


def text_rows(texts: list[str | bytes | None]) -> Rows:
    """The text_features() of many texts, worked out for about SIDE_BY_SIDE bytes of texts at a time."""
    raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
    found, some, size = [Rows.of(np.zeros((0, SHAPES)))], [], 0
    for raw in raws:
        if some and size + len(raw) > SIDE_BY_SIDE:
            found.append(_side_by_side(some))
            some, size = [], 0
        some.append(raw)
        size += len(raw)
    if some:
        found.append(_side_by_side(some))
    return found[0].join(*found[1:])


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of some runs laid end to end starts, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)])


def _side_by_side(raws: list[bytes]) -> Rows:
    """Features of texts in UTF-8.  They are laid end to end, one line end apart, so that no word or line spans two."""
    whole, n = b"\n".join(raws), len(raws)
    low, octets = whole.lower(), np.frombuffer(whole, np.uint8)
    lengths = np.fromiter(map(len, raws), np.int64, n)
    froms = _starts(lengths + 1)[:-1]
    space = np.concatenate([[True], _SPACE[octets], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.append(np.searchsorted(starts, froms), len(starts))
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)

    def total(x: np.ndarray) -> np.ndarray:
        return np.diff(_starts(x)[bounds])

    sizes, first, last = ends - starts, octets[starts], octets[ends - 1]
    bits = _BITS[octets]
    bits[ends[_STOPS[last]] - 1] &= 255 - _HAS_OTHER  # a plain word may end in one stop
    has = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits[:0]
    plain = _LETTER[first] & (has & _HAS_OTHER == 0)
    marks = (sizes > 1) & _SYMBOL[last] & _SYMBOL[octets[np.maximum(ends - 2, 0)]]

    numbers: dict[bytes, int] = defaultdict(count().__next__)  # each word gets the next number when it is first met
    ids = np.fromiter(map(numbers.__getitem__, low.split()), np.int64, len(starts))  # bytes: ASCII white space only
    word_places = np.fromiter(map(zlib.crc32, numbers), np.int64, len(numbers)) % WORD_PLACES
    width = len(numbers).bit_length()
    keys = np.sort((owner * WORD_PLACES + word_places[ids]) << width | ids)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    times, of = np.diff(new, append=len(keys)), keys[new] >> width
    kinds = np.bincount(of // WORD_PLACES, minlength=n)
    most = np.zeros(n, np.int64)
    most[kinds > 0] = np.maximum.reduceat(times, (np.cumsum(kinds) - kinds)[kinds > 0]) if len(times) else 0
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
    of, held = of[new], np.add.reduceat(times, new) if len(new) else times
    n_words_held = np.bincount(of // WORD_PLACES, minlength=n)

    lines = [[x for x in raw.split(b"\n") if x and not x.isspace()] for raw in raws]
    rows = np.maximum(np.fromiter(map(len, lines), np.int64, n), 1)
    other = np.fromiter((len(set(x)) for x in lines), np.int64, n)
    some = np.maximum(n_words, 1)
    dense = np.column_stack([
        np.log1p(n_words) / 10, total(sizes) / some / 10, kinds / some, kinds / np.sqrt(some) / 10, total(plain) / some, total(marks) / some, total(has & _HAS_ALNUM == 0) / some,
        total((sizes > 1) & (has & _HAS_UPPER > 0) & (has & _HAS_LOWER == 0)) / some, total(_DIGIT[first]) / some, most / some,
        total(np.concatenate([[False], (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])])[: len(ids)]) / some,
        1 - other / rows, np.minimum(n_words / rows, 200) / 200, total(sizes > 20) / some,
    ])
    dense[n_words == 0] = 0.0

    octets = np.frombuffer(low, np.uint8).astype(np.uint32)
    n_grams = np.where(n_words > 0, np.maximum(lengths - GRAM + 1, 0), 0)
    gram = octets[: max(len(octets) - GRAM + 1, 0)].copy()
    for j in range(1, GRAM):
        gram *= np.uint32(256)
        gram += octets[j : len(gram) + j]
    gram *= np.uint32(2654435761)
    gram >>= np.uint32(20)
    grams, grams_held = [], []
    for a in range(0, n, COUNTED):
        each = range(a, min(a + COUNTED, n))
        keys = np.concatenate([gram[froms[i] : froms[i] + n_grams[i]] + np.uint32((i - a) * GRAM_PLACES) for i in each])
        counts = np.bincount(keys, minlength=len(each) * GRAM_PLACES)
        at = np.flatnonzero(counts != 0)
        grams.append(at + a * GRAM_PLACES)
        grams_held.append(counts[at])
    grams = np.concatenate(grams)
    n_grams_held = np.bincount(grams // GRAM_PLACES, minlength=n)

    sizes = n_words_held + n_grams_held
    to_words = np.arange(len(of)) + np.repeat(_starts(n_grams_held)[:-1], n_words_held)
    to_grams = np.arange(len(grams)) + np.repeat(_starts(n_words_held)[1:], n_grams_held)
    places, counts = np.empty(len(of) + len(grams), np.int32), np.empty(len(of) + len(grams), np.int64)
    places[to_words], places[to_grams] = of % WORD_PLACES, grams % GRAM_PLACES + WORD_PLACES
    counts[to_words], counts[to_grams] = held, np.concatenate(grams_held)
    values = _LOGS[np.minimum(counts, len(_LOGS) - 1)]
    large = np.flatnonzero(counts >= len(_LOGS))
    values[large] = np.log1p(counts[large])
    full = np.flatnonzero(sizes)
    norms = np.sqrt(np.add.reduceat(values * values, _starts(sizes)[full])) if len(full) else values
    return Rows(dense, sizes, places, (values / np.repeat(norms, sizes[full])).astype(np.float32))


def meta_features(source: object, lang: object, n_chars: object) -> list[float]:
    """Metadata alone: hashed source and language, and the recorded length.  Nulls have a place of their own."""
    out = [0.0] * (PLACES + 2)
    for name, value in (("source", source), ("lang", lang)):
        out[zlib.crc32(f"{name}={value}".encode("utf-8", "replace")) % PLACES] += 1.0
    size = float(n_chars or 0)
    size = math.log1p(max(size, 0.0)) / 10 if math.isfinite(size) else 0.0
    out[PLACES], out[PLACES + 1] = size, size * size
    return out


def _expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _expit(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A logistic classifier over one view: standardised dense features, with pairs and squares where asked for, and content.

    The dense features are fitted first, by Newton's method; the content's weights then by stochastic gradient steps
    that add to what the dense features say.
    """

    squares: bool
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    content: np.ndarray = field(default_factory=lambda: np.zeros(CONTENT))

    def _wide(self, x: np.ndarray) -> np.ndarray:
        if not self.squares:
            return x
        i, j = np.triu_indices(x.shape[1])
        return np.column_stack([x, x[:, i] * x[:, j]])

    def fit(self, rows: Rows, y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.5, ridge: float = 1e-3) -> None:
        wide = self._wide(rows.dense)
        self.mean, self.scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
        self.weights = _logistic((wide - self.mean) / self.scale, y, ridge=1.0)
        self.content = np.zeros(CONTENT)
        if not len(rows.places):
            return
        known, steep = self.logit(rows), np.full(CONTENT, 1e-3)
        starts = np.concatenate([[0], np.cumsum(rows.sizes)]).astype(np.int64)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                flat = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in at.tolist()])
                places, values, owner = rows.places[flat], rows.values[flat], np.repeat(np.arange(len(at)), rows.sizes[at])
                z = known[at] + np.bincount(owner, weights=self.content[places] * values, minlength=len(at))
                error = (_expit(z) - y[at]) / len(at)
                slope = np.bincount(places, weights=values * error[owner], minlength=CONTENT) + ridge * self.content / len(order)
                steep += slope * slope
                self.content -= rate * slope / np.sqrt(steep)

    def logit(self, rows: Rows) -> np.ndarray:
        wide = (self._wide(rows.dense) - self.mean) / self.scale
        z = np.clip(wide, -8, 8) @ self.weights[:-1] + self.weights[-1]
        ends = np.cumsum(rows.sizes)
        for a in range(0, len(rows) if len(rows.places) else 0, 256):
            b = min(a + 256, len(rows))
            some = slice(ends[a] - rows.sizes[a], ends[b - 1])
            owner = np.repeat(np.arange(b - a), rows.sizes[a:b])
            z[a:b] += np.bincount(owner, weights=self.content[rows.places[some]] * rows.values[some], minlength=b - a)
        return np.clip(z, -30, 30)


@dataclass
class CoTrained:
    """Two views and their calibrated combination; without any, every row gets the prior."""

    prior: float
    text: View | None = None
    meta: View | None = None
    combine: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def score(self, text: np.ndarray | Rows, meta: np.ndarray | Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality by the text view, by the metadata view, and combined."""
        if self.text is None or not len(text):
            same = np.full(len(text), self.prior)
            return same, same, same
        a, b = self.text.logit(Rows.of(text)), self.meta.logit(Rows.of(meta))
        return _expit(a), _expit(b), _expit(self.combine[0] * a + self.combine[1] * b + self.combine[2])


class CoTraining:
    """Co-training: in each round either view labels the rows that it is surest of, for the other view to learn.

    A fifth of the labelled rows takes no part in that; on it a logistic regression over both views' log odds calibrates
    and combines them, so a view without information gets no weight.  ``shift`` is what the log odds of the classes
    among all labelled rows have over those in the sample.
    """

    def __init__(self, text: np.ndarray | Rows, meta: np.ndarray | Rows, y: np.ndarray, shift: float = 0.0, prior: float | None = None):
        self.prior = prior if prior is not None else float(y.mean()) if len(y) else 1.0
        self.shift = shift
        self.views = (View(squares=True), View(squares=False))
        self.able = len(y) >= 20 and min(y.sum(), len(y) - y.sum()) >= 2
        if self.able:
            held = np.arange(len(y)) % 5 == 4
            text, meta = Rows.of(text), Rows.of(meta)
            self.held, self.held_y = (text.take(held), meta.take(held)), y[held]
            self.x, self.y = [text.take(~held), meta.take(~held)], [y[~held], y[~held]]
            self.fit()

    def fit(self) -> None:
        for view, x, y in zip(self.views, self.x, self.y):
            view.fit(x, y)

    def learn(self, view: int, rows: Rows, labels: np.ndarray) -> None:
        """Give a view rows that the other one has labelled."""
        self.x[view] = self.x[view].join(rows)
        self.y[view] = np.concatenate([self.y[view], labels])

    def model(self) -> CoTrained:
        if not self.able:
            return CoTrained(self.prior)
        both = np.column_stack([v.logit(x) for v, x in zip(self.views, self.held)])
        combine = _logistic(both, self.held_y, ridge=1.0)
        combine[2] += self.shift
        return CoTrained(self.prior, *self.views, combine)


def co_train(text: np.ndarray | Rows, meta: np.ndarray | Rows, y: np.ndarray, pool_text: np.ndarray | Rows, pool_meta: np.ndarray | Rows) -> CoTrained:
    """Co-training where all rows are at hand; fit() does the same over a table."""
    run, pools = CoTraining(text, meta, y), (Rows.of(pool_text), Rows.of(pool_meta))
    free = np.ones(len(pool_text), dtype=bool)
    for _ in range(ROUNDS if run.able else 0):
        taken = []
        for v, view in enumerate(run.views):
            at = np.flatnonzero(free)
            if not len(at):
                break
            p = _expit(view.logit(pools[v].take(at)))
            good = at[np.argsort(-p, kind="stable")[: min(EXCHANGED, int((p >= SURE).sum()))]]
            bad = at[np.argsort(p, kind="stable")[: min(EXCHANGED, int((p <= 1 - SURE).sum()))]]
            for rows, label in ((good, 1.0), (bad, 0.0)):
                taken.append(len(rows))
                run.learn(1 - v, pools[1 - v].take(rows), np.full(len(rows), label))
                free[rows] = False
        if not sum(taken):
            break
        run.fit()
    return run.model()


_VIEWED = ("body", "source", "lang", "n_chars")


def _features(columns: list[list]) -> tuple[Rows, Rows]:
    """The text view's and the metadata view's features of some rows, given by the lists of their _VIEWED columns, texts as bytes or not."""
    meta = np.array([meta_features(*m) for m in zip(*columns[1:])]).reshape(len(columns[0]), PLACES + 2)
    return text_rows(columns[0]), Rows.of(meta)


_EXTRACTED = "id {id}, quality int, label_view int, shapes binary, places binary, values binary, meta binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as bytes, for the driver."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            out: list[list[bytes]] = [[], [], [], []]
            for body, *meta in zip(*(batch.column(c).to_pylist() for c in _VIEWED)):
                shapes, places, values = text_features(body)
                for column, x in zip(out, (np.array(shapes), places, values, np.array(meta_features(*meta)))):
                    column.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("quality"), batch.column("label_view"), *(pa.array(x, pa.binary()) for x in out)],
                ["id", "quality", "label_view", "shapes", "places", "values", "meta"],
            )


def _gathered(found) -> tuple[Rows, Rows]:
    """The rows of a frame from _extract()."""
    read = lambda c, kind: np.frombuffer(b"".join(found[c]), dtype=kind)
    sizes = np.array([len(b) // 4 for b in found["places"]], dtype=np.int64)
    text = Rows(read("shapes", float).reshape(-1, SHAPES), sizes, read("places", np.int32), read("values", np.float32))
    return text, Rows.of(read("meta", float).reshape(-1, PLACES + 2))


_SCORES = "struct<text_score:double,meta_score:double,score:double>"


def _scorer(shared):
    """An Arrow UDF of the _VIEWED columns: the three scores of each row.  All other columns stay where they are."""

    def score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model: CoTrained = shared.value
        for batch in batches:
            scores = [[np.zeros(0)] * 3]
            viewed = (batch[0].cast(pa.large_binary()), *batch[1:])  # the text view works on bytes
            scores += [model.score(*_features(list(columns))) for columns in zip(*(parts(c) for c in viewed))]
            columns = [pa.array(np.concatenate(x), pa.float64()) for x in zip(*scores)]
            yield pa.StructArray.from_arrays(columns, ["text_score", "meta_score", "score"])

    return F.arrow_udf(score, _SCORES).asNondeterministic()  # a filter on a score must not evaluate it again


def _views(docs: DataFrame, id_col: str) -> dict[str, Column]:
    have = set(docs.columns)
    column = lambda c, kind: (F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind)
    return {
        "id": F.col(f"`{id_col}`"), "body": F.col("text"), "source": column("source", "string"), "lang": column("lang", "string"), "n_chars": column("n_chars", "double"),
    }


def _sample(known: DataFrame, rows: int) -> tuple[DataFrame, float, float | None]:
    """About rows / 2 rows of either class, by a hash of their id; the shift of the log odds that this makes; the prior."""
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = {q: min(1.0, rows / 2 / n) for q, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30))
    limit = F.when(F.col("quality") == 1, int((1 << 30) * share.get(1, 1.0))).otherwise(int((1 << 30) * share.get(0, 1.0)))
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    return known.filter(draw < limit), math.log(share.get(0, 1.0) / share.get(1, 1.0)), good / (good + bad) if good + bad else None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = FIT_ROWS) -> CoTrained:
    """Fit on about ``rows`` labelled rows, and on those of all others that a view is surest of.

    Of labels that disagree on an id the worst counts.  In each round all rows without a label are scored by both views;
    each view's EXCHANGED surest rows of either class, if it is SURE of them, go to the other view.  Only these and the
    labelled sample reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    views = docs.select(*(c.alias(name) for name, c in _views(docs, id_col).items()))
    known = labels.filter(F.col("quality").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), "quality").filter(F.col("id").isNotNull())
    known = known.groupBy("id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    chosen, shift, prior = _sample(known, rows)
    schema = _EXTRACTED.format(id=views.schema["id"].dataType.simpleString())
    labelled = views.join(F.broadcast(chosen), "id").withColumn("label_view", F.lit(None).cast("int"))
    found = labelled.select(*views.columns, "quality", "label_view").mapInArrow(_extract, schema).toPandas()
    found = found.sort_values(["id", "places"], kind="stable")
    run = CoTraining(*_gathered(found), found["quality"].to_numpy(dtype=float), shift, prior)
    del found
    taken: list[int] = []
    for _ in range(ROUNDS if run.able else 0):
        score = _scorer(spark.sparkContext.broadcast(CoTrained(0.5, *run.views)))
        key = F.xxhash64("id", "body")
        pool = views.select("id", key.alias("key"), score(*_VIEWED).alias("s")).select("id", "key", "s.text_score", "s.meta_score")
        sure = pool.filter(F.greatest("text_score", "meta_score", 1 - F.col("text_score"), 1 - F.col("meta_score")) >= SURE)
        sure = checkpointed(sure.join(known.select("id"), "id", "left_anti").filter(~F.col("key").isin(taken) if taken else F.lit(True)))
        best: dict[int, tuple[int, int]] = {}
        for view, column in enumerate(("text_score", "meta_score")):
            for label, chance in ((1, F.col(column)), (0, 1 - F.col(column))):
                top = sure.filter(chance >= SURE).groupBy("key").agg(F.max(chance).alias("chance")).orderBy(F.desc("chance"), "key").limit(EXCHANGED)
                for r in top.collect():
                    best.setdefault(r.key, (label, view))
        if not best:
            break
        taken += best
        given = spark.createDataFrame([(k, label, view) for k, (label, view) in best.items()], "key long, quality int, label_view int")
        fetched = views.withColumn("key", key).join(F.broadcast(given), "key").select(*views.columns, "quality", "label_view")
        found = fetched.mapInArrow(_extract, schema).toPandas().sort_values(["id", "places"], kind="stable").drop_duplicates(["id", "places"])
        text, meta = _gathered(found)
        for view in (0, 1):
            at = (found["label_view"] == view).to_numpy()
            run.learn(1 - view, (meta, text)[view].take(at), found["quality"].to_numpy(dtype=float)[at])
        run.fit()
    return run.model()


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Score every row of docs by both views: id, text_score, meta_score, score, kept.

    The text view sees the whole text only: its shape, and its words and character n-grams by hash.  The metadata
    view sees source, language and recorded length only.  Nulls and missing columns count as a value of their own, a null
    text as empty.  score is the calibrated chance of good quality; rows below the threshold are rejected.  With fewer
    than 20 labelled rows, or fewer than two of a class, no model can be fitted: every row gets the share of good labels
    as its score and is kept.  Repeated ids are rows of their own; an empty table gives an empty result.  With ``carry``
    all columns of docs follow as a struct ``row``, which does not pass through Python.
    """
    fitted = fit(docs, labels, id_col)
    score = _scorer(docs.sparkSession.sparkContext.broadcast(fitted))
    view = _views(docs, id_col)
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    out = docs.select(view["id"].alias("id"), score(*(view[c] for c in _VIEWED)).alias("s"), *own)
    kept = F.col("s.score") >= threshold if fitted.text is not None else F.lit(True)
    return out.select(F.col("id").alias(id_col), "s.text_score", "s.meta_score", "s.score", kept.alias("kept"), *(["row"] if carry else []))


def good_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs.

    Each row is judged by itself: null and repeated ids, and repeated rows, stay or go one by one.  Where no model can be
    fitted all rows stay.
    """
    return classify(docs, labels, carry=True).filter("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
