"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, parts, ship, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Shortest run that the battery tests, the false-discovery rate, and lower ends of the length classes.
LEAST, RATE, CLASSES = 16, 0.001, (16, 20, 24, 32, 48, 80)
#: Runs whose symbols the battery finds less uniform than this are not taken for random.
UNIFORM = 0.01
#: Fixed values of ordinary text: chance that two letters agree, that three do, that the character class changes from
#: one symbol to the next, the share of neighbours of which one is a vowel and one isn't, and the vowels' serial correlation.
PAIR, TRIPLE, CHANGE, TURN, VOWELS = 0.066, 0.0055, 0.06, 0.65, -0.3
#: Counts from which on tails are those of the normal distribution.
LARGE = 1000
#: Evidence is counted in steps of a quarter of a power of ten, up to this many.
STEPS = 240

#: Encodings from the narrowest on: pattern, number of symbols, and those of each character class.
_ENCODINGS = {
    "hex": (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, (10, 6)),
    "letters": (re.compile(r"[a-z]+|[A-Z]+"), 26, (26,)),
    "base32": (re.compile(r"[A-Z2-7]+"), 32, (26, 6)),
    "base36": (re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36, (26, 10)),
    "base62": (re.compile(r"[A-Za-z0-9]+"), 62, (26, 26, 10)),
    "base64": (re.compile(r"[A-Za-z0-9+]+"), 63, (26, 26, 10, 1)),
}
_VOWELS = frozenset("aeiouyAEIOUY")


def _lower_tail(z: float) -> float:
    return max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-30)


def _at_least(k: int, n: int, p: float) -> float:
    """P(X >= k), X binomial; by the normal distribution where n is large."""
    if k <= 0:
        return 1.0
    if n > LARGE:
        return _lower_tail((n * p - k + 0.5) / math.sqrt(n * p * (1 - p)))
    total, term = 0.0, math.lgamma(n + 1)
    for i in range(k, n + 1):
        total += math.exp(term - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(max(total, 1e-30), 1.0)


def _at_most(k: int, n: int, p: float) -> float:
    return _at_least(n - k, n, 1 - p)


def _many(k: int, mean: float) -> float:
    """P(X >= k), X Poisson; by the normal distribution where the mean is large."""
    if k <= 0:
        return 1.0
    if k > LARGE:
        return _lower_tail((mean - k + 0.5) / math.sqrt(mean))
    below = sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k))
    return min(max(1 - below, 1e-30), 1.0)


def _fisher(*chances: float) -> float:
    """Fisher's combination of three p-values."""
    half = -sum(map(math.log, chances))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def _kinds(body: str | list[str]) -> list[str]:
    """The class of each symbol; a capital before a small letter begins a word and counts as one."""
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in body]
    return ["l" if a == "u" and b == "l" else a for a, b in zip(kinds, [*kinds[1:], ""])]


@cache
def _change(classes: tuple[int, ...]) -> float:
    """The chance that the class changes from one uniform symbol to the next, given the number of symbols of each class."""
    size, symbols = sum(classes), "aA0+" if len(classes) > 2 else "a0"
    return sum(
        x * y * z / size**3
        for (x, a), (y, b), (z, c) in product(zip(classes, symbols), repeat=3)
        if len(set(_kinds([a, b, c])[:2])) > 1
    )


def battery(run: str) -> tuple[str, float, float]:
    """(encoding, p-value of uniform random symbols, p-value of ordinary text) of a run, by three statistics.

    * agreeing pairs of symbols, which is the chi-squared statistic of uniformity over the inferred encoding's alphabet;
    * runs of one character class; of vowels or consonants where the encoding has one class alone;
    * serial correlation of vowels.
    Each is held against what uniform symbols of the encoding give, and against what text gives: text has more agreeing
    pairs, seldom changes class, and alternates vowels with consonants.  Fisher's method combines the three.  Separators
    and padding are left out.  Digits alone look as a number does: they give 1 for text.
    """
    body = re.sub(r"[-_=/]", "", run)
    n = len(body)
    if n < LEAST or body.isdigit():
        return "digits" if body.isdigit() else "short", 1.0, 1.0
    name, (_, size, classes) = next((name, e) for name, e in _ENCODINGS.items() if e[0].fullmatch(body))
    pairs = sum(f * (f - 1) for f in Counter(body).values()) // 2
    every = n * (n - 1) / 2
    vowels = [c in _VOWELS for c in body]
    m = sum(vowels) / n
    r = sum((a - m) * (b - m) for a, b in zip(vowels, vowels[1:])) / (n * m * (1 - m)) if 0 < m < 1 else None
    if len(classes) > 1:
        kinds, change = _kinds(body), _change(classes)
    else:
        kinds, change = vowels, 2 * (6 / 26) * (20 / 26)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))

    uniform = _fisher(
        _many(pairs, every / size),
        min(1.0, 2 * min(_at_least(changes, n - 1, change), _at_most(changes, n - 1, change))),
        2 * _lower_tail(-abs(r) * math.sqrt(n)) if r is not None else 1.0,
    )
    share = max(PAIR, 1.5 / size)  # of agreeing pairs in text of this alphabet
    spread = every * share * (1 - share) + n * (n - 1) * (n - 2) * max(TRIPLE - PAIR * PAIR, 0)
    text = _fisher(
        _lower_tail((pairs - every * share) / math.sqrt(spread)),
        _at_least(changes, n - 1, CHANGE) if len(classes) > 1 else _at_most(changes, n - 1, TURN),
        _lower_tail(-(r - VOWELS) * math.sqrt(n)) if r is not None else 0.5,
    )
    return name, uniform, text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns, sorted."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)] if any(len(c) >= 16 for c in low.split()) else []
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, steps of evidence) of each run, or of what the spans in taken leave of it."""
    out, at = [], 0
    for chunk in text.split():
        if len(chunk) < LEAST:
            continue
        at = text.find(chunk, at)
        for m in RUN.finditer(chunk):
            begin, close = at + m.start(), at + m.end()
            inside = [(s, e) for s, _, e in taken if s < close and begin < e]
            for start, end in zip([begin, *(e for _, e in inside)], [*(s for s, _ in inside), close]):
                if end - start >= LEAST:
                    _, uniform, p = battery(text[start:end])
                    steps = min(STEPS, int(-4 * math.log10(max(p, 1e-60)))) if uniform >= UNIFORM else 0
                    out.append((start, end, sum(end - start >= low for low in CLASSES) - 1, steps))
        at += len(chunk)
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("steps", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, runs = [], []
        for text in (t for some in parts(batch.column("body")) for t in some):
            base.append(base_spans(text or ""))
            runs.append(candidates(text or "", base[-1]))
        count = lambda k: pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), count(0), count(1), count(2),
                pa.array([hashlib.sha256(_named(x).encode()).hexdigest() for x in base]),
                pa.array([[{"start": s, "rank": k, "end": e} for s, k, e in x] for x in base], pa.list_(_SPAN)),
                pa.array([[dict(zip(("start", "end", "length", "steps"), r)) for r in x] for x in runs], pa.list_(_RUN)),
            ],
            ["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"],
        )


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg within each length class: the fewest steps of evidence at which the rate holds."""
    out = {}
    for length in range(len(CLASSES)):
        tests = sum(n for (c, _), n in counts.items() if c == length)
        above, best = 0, STEPS + 1
        for step in range(STEPS, 0, -1):
            above += counts.get((length, step), 0)
            if above and 10 ** (-step / 4) <= rate * above / tests:
                best = step
        out[length] = best
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Secrets in every whole text: assignments, access keys, hexadecimal runs, and runs that look random.

    Runs of LEAST or more base64 or URL-safe symbols outside the fixed patterns' spans go through battery().  Those that
    it finds uniform over their encoding are random unless they may be text.  That evidence is counted over all documents
    by length class, in STEPS steps each, and Benjamini-Hochberg sets each class's threshold: only those counts, of bounded
    number, reach the driver.

    Returns id, n_assign, n_access, n_hex, base_sha256, spans, and found, an array of (kind, start, end) in code points.
    Null text counts as empty; ids may be null or repeat, each row gives one row; texts of any length are read whole; an
    empty table gives an empty result; other columns play no part.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    schema = (
        f"id {source.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "base array<struct<start:long,rank:int,end:long>>, runs array<struct<start:long,end:long,length:int,steps:int>>"
    )
    scanned = checkpointed(source.mapInArrow(_scan, schema))
    counted = scanned.select(F.explode("runs").alias("r")).groupBy("r.length", "r.steps").count()
    least = thresholds({(r[0], r[1]): r[2] for r in counted.collect()}, rate)
    cut = F.array(*(F.lit(least[c]) for c in range(len(CLASSES))))
    random = F.transform(
        F.filter("runs", lambda r: r["steps"] >= F.get(cut, r["length"])),
        lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("rank"), r["end"].alias("end")),
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    found = F.transform(
        F.array_sort(F.concat("base", random)),
        lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return scanned.withColumn("found", found).select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        "found",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")
