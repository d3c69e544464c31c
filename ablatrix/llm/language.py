"""Language ID: word-first backoff to character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import parts, ship, table

#: The classifier is fitted on about FIT_ROWS labelled rows at most, as many of each language, chosen by a hash of their id.
FIT_ROWS = 8_000
#: Orders of character n-grams.
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words that a task remembers at a time.
REMEMBERED = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) in lower case."""
    found = LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()  # numerals among the letters


def grams(word: str, order: int) -> list[str]:
    padded = f"<{word}>" if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, token, n) of a partition; order 0 stands for words."""
    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), (t for some in parts(batch.column("body")) for t in some)):
            seen.setdefault(lang, Counter()).update(words(text))
    for lang, counts in seen.items():
        for order in (0, *ORDERS):
            tokens = counts
            if order:
                tokens = Counter()
                for word, n in counts.items():
                    for g in grams(word, order):
                        tokens[g] += n
            names, n = list(tokens), list(tokens.values())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([order] * len(part), pa.int32()), pa.array(part), pa.array(n[at : at + 50_000], pa.int64())],
                    ["lang", "order", "token", "n"],
                )


@dataclass
class Model:
    """Log frequency of each kept token by language: one row of table a token, the row's number in index[order]."""

    languages: list[str]
    index: dict[int, dict[str, int]]
    table: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's n-grams of the longest order of which any is known."""
        for order in ORDERS:
            known = self.index[order]
            rows = [known[g] for g in grams(word, order) if g in known]
            if rows:
                return self.table[rows].mean(axis=0, dtype=float)
        return np.zeros(len(self.languages))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on docs (id, body, lang) with a language: about ``rows`` of them, so many of each language as there are or fit.

    All words and n-grams of that sample reach the driver with their counts; the sample bounds them.
    """
    labelled = docs.filter(F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {order: {} for order in (0, *ORDERS)}, np.zeros((0, 0), np.float32))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, int((1 << 30) * min(1.0, rows / len(languages) / sizes[lang])))))
    labelled = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])
    counted = labelled.select("lang", "body").mapInArrow(_count, "lang string, order int, token string, n long")
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{j}") for j, lang in enumerate(languages)]
    kept = counted.groupBy("order", "token").agg(*each).toArrow()
    orders = kept["order"].to_numpy()
    index: dict[int, dict[str, int]] = {}
    values, smooth = np.zeros((len(orders), len(languages)), np.float32), 0.1
    for order in (0, *ORDERS):
        at = np.flatnonzero(orders == order)
        index[order] = dict(zip(kept["token"].take(pa.array(at)).to_pylist(), at.tolist()))
        for j in range(len(languages)):
            n = kept[f"n{j}"].to_numpy()[at]
            values[at, j] = np.log((n + smooth) / (n.sum() + smooth * ((n > 0).sum() + 1)))
    return Model(languages, index, values)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known, seen = model.index[0], {}
        vectors: list[np.ndarray] = []
        for batch in batches:
            best, score = [], []
            for text in (t for some in parts(batch.column("body")) for t in some):
                found = words(text)
                if not found or not model.languages:
                    best.append("und")
                    score.append(0.0)
                    continue
                at = [known.get(w, -1) for w in found]
                rows = np.array(at)
                total = model.table[rows[rows >= 0]].sum(axis=0, dtype=float)
                for w, i in zip(found, at):
                    if i < 0:
                        v = seen.get(w)
                        if v is None:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            v = seen[w] = model.unseen(w)
                        total = total + v
                chance = np.exp(total - total.max())
                winner = int(chance.argmax())
                best.append(model.languages[winner])
                score.append(float(chance[winner] / chance.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Predict the language of every whole text, learning from the rows where ``train`` holds and lang isn't null.

    Words are lower-case runs of letters (Unicode category L).  A known word scores by its log frequency in each language; an unseen one by
    its n-grams of five characters, else of four, down to one.  Scores add up over the text; score is the posterior of
    the best language under equal priors, ties going to the first in order.  The fit uses about fit_rows rows at most,
    as many of each language; whatever they hold is known, so their number bounds the model that is broadcast.

    Returns id, held_out (train doesn't hold), lang_pred, score.  A null text, one without letters, and any text where
    nothing can be learned get ``und`` and 0.  Ids may be null or repeat; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), F.col(f"`{lang_col}`").alias("lang"), (~train).alias("held_out")
    )
    model = spark.sparkContext.broadcast(fit(source.filter(~F.col("held_out")), fit_rows))
    id_type = source.schema["id"].dataType.simpleString()
    out = source.select("id", "body", "held_out").mapInArrow(_predict(model), f"id {id_type}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def in_fold(modulus: int, fold: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus, is fold; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(modulus)) == fold


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), ~in_fold(4, 2))
