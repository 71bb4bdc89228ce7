"""Quality classifier by co-training.

Two views of a document are judged by separate logistic models: its text (hashed words, word beginnings and the layout),
and its metadata (source, language and length as the table has them), which never look at each other's features. In each
round both views score all documents without labels, and each passes the AT_MOST documents of either class that it is most
sure of to the other view's training set; equal texts count once. At the end each view is calibrated on labelled documents
held out from training, and the calibrated log-odds are added (less the prior, which both contain). This is done for two
marks: low quality, and toxic. All documents are scored.

Features of all documents are made once on the executors and written. Models are fitted on the driver, on at most LABELLED
labelled documents, those with the smallest hashes of their ids, and what the views exchange; both are bounded, and nothing
else is collected.

Defined cases: a null or empty text has no words and scores by its layout and metadata; null metadata is a category of its
own, one that no fitted document has says nothing; documents with several label rows take the lowest quality and the
highest toxic mark, nulls ignored; of labelled rows with one id the one with the smallest text hash is taken; without
labels of both kinds a mark gets probability 0 everywhere, so all is kept; rows are scored one by one, repeated ones alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.decontamination import terms
from docweave.llm.shared import scratch, staged

LABELLED = 6000
BITS = 18
ROUNDS, SURE = 2, 0.95
#: Documents of either class that a view passes to the other in a round.
AT_MOST = 300
#: Every so many of the labelled documents are held out for calibration.
HELD_OUT = 5
#: Least G statistic of a hashed feature against the labels (chance exceeds it once in 100,000).
LEAST_G = 20.0

UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
MARKS = ("low_quality", "toxic")
SHAPES = 12
WIDTH = 1 << BITS
#: A gap between buckets that does not fit in 16 bits.
MORE = 0xFFFF


def hashed(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: the word itself, and its beginning."""
    low = (1 << BITS) - 1
    return xxhash.xxh32_intdigest(word) & low, xxhash.xxh32_intdigest(b"^" + word[:4]) & low


def content(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    found = {b for w in set(terms(text)) for b in hashed(w)}
    out = np.fromiter(found, np.int32, len(found))
    out.sort()
    return out


def packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as 16-bit gaps; MORE adds to the gap that follows."""
    gaps = np.diff(buckets, prepend=0)
    large = gaps >= MORE
    if large.any():
        gaps = np.concatenate([[MORE] * (g // MORE) + [g % MORE] for g in gaps.tolist()]).astype(np.int64)
    return gaps.astype(np.uint16).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    at = np.cumsum(gaps, dtype=np.int64)
    return at[gaps != MORE]


def layout(text: str | None) -> np.ndarray:
    """SHAPES numbers."""
    data = (text or "").encode()
    n, words = max(1, len(data)), data.split()
    return np.array((
        math.log1p(len(text or "")),
        (n - len(data.translate(None, UPPER))) / n,
        (n - len(data.translate(None, DIGITS))) / n,
        (n - len(data.translate(None, b"#*$%&<>"))) / n,
        data.count(b"!") / n,
        data.count(b"|") / n,
        data.count(b"\n") / n,
        len(set(words)) / max(1, len(words)) * math.log1p(len(words)) / 5,
        len(data) / max(1, len(words)) / 10,
        sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words)),
        sum(map(bytes.isupper, words)) / max(1, len(words)),
        (n - len(data.translate(None, b"#*$%&|<>!"))) / max(1, len(words)),
    ), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows of ones, as buckets end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, e: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, weights=e[self.row], minlength=width)


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, e: np.ndarray, width: int) -> np.ndarray:
        return self.x.T @ e


class Both:
    """Sparse buckets, then dense numbers."""

    def __init__(self, rows: Rows, dense: Dense):
        self.rows, self.dense, self.n = rows, dense, rows.n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.rows.dot(w) + self.dense.dot(w[WIDTH:])

    def back(self, e: np.ndarray, width: int) -> np.ndarray:
        return np.concatenate([self.rows.back(e, WIDTH), self.dense.back(e, width - WIDTH)])


def logistic(rows: Rows | Dense | Both, y: np.ndarray, width: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and intercept, by Adam on all rows at once; both classes weigh the same in sum, up to four times."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, min(4.0, 0.5 / share), min(4.0, 0.5 / (1 - share)))
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        e = (sigmoid(rows.dot(w) + b) - y) * weight / len(y)
        g = rows.back(e, width) + l2 * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def informative(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Which buckets tell the classes apart, by the likelihood-ratio (G) test of presence against class.

    Most words are in few documents and say nothing; their weights would only add noise that grows with a text's length.
    """
    in_1, in_0 = (np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == k] or [np.zeros(0, np.int32)]), minlength=width).astype(float) for k in (1, 0))
    n_1, n_0 = float((y == 1).sum()), float((y == 0).sum())
    seen, n, g = in_1 + in_0, n_1 + n_0, np.zeros(width)
    for here, docs in ((in_1, n_1), (in_0, n_0)):
        for observed, expected in ((here, seen * docs / n), (docs - here, (n - seen) * docs / n)):
            g += 2 * observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12))
    return g >= LEAST_G


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept that calibrate log-odds z; smoothed targets, damped Newton."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


@dataclass(frozen=True)
class Example:
    """A document's features; y: 1, 0 or None by mark."""

    words: np.ndarray
    shape: np.ndarray
    source: str | None
    lang: str | None
    size: float
    y: dict[str, int | None] = field(default_factory=dict)


@dataclass(frozen=True)
class TextModel:
    words: np.ndarray
    shape: np.ndarray
    bias: float

    def odds(self, words: np.ndarray, shape: np.ndarray) -> float:
        return float(self.words[words].sum(dtype=np.float64) + shape @ self.shape + self.bias)


@dataclass(frozen=True)
class MetaModel:
    source: dict[str | None, float]
    lang: dict[str | None, float]
    size: float
    bias: float

    def odds(self, source: str | None, lang: str | None, size: float) -> float:
        return self.source.get(source, 0.0) + self.lang.get(lang, 0.0) + self.size * size + self.bias


def fit_text(examples: list[Example], y: np.ndarray) -> TextModel:
    """Words that do not tell the classes apart have weight 0."""
    words = [e.words for e in examples]
    use = informative(words, y, WIDTH)
    x = np.array([e.shape for e in examples], np.float64).reshape(-1, SHAPES)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    w, b = logistic(Both(Rows([r[use[r]] for r in words]), Dense((x - mean) / sd)), y, WIDTH + SHAPES, 1e-4, 200, 0.1)
    shape = w[WIDTH:] / sd
    return TextModel(w[:WIDTH].astype(np.float32), shape, float(b - shape @ mean))


def fit_metadata(examples: list[Example], y: np.ndarray) -> MetaModel:
    """A weight for each source and language of the examples, and one for the length."""
    at: dict[tuple[int, str | None], int] = {}
    for e in examples:
        at.setdefault((0, e.source), len(at))
        at.setdefault((1, e.lang), len(at))
    rows = Rows([np.array([at[(0, e.source)], at[(1, e.lang)]]) for e in examples])
    size = np.array([[e.size] for e in examples])
    mean, sd = size.mean(), size.std() + 1e-6

    class Mixed(Both):
        def dot(self, w: np.ndarray) -> np.ndarray:
            return self.rows.dot(w) + self.dense.dot(w[len(at) :])

        def back(self, e: np.ndarray, width: int) -> np.ndarray:
            return np.concatenate([self.rows.back(e, len(at)), self.dense.back(e, 1)])

    w, b = logistic(Mixed(rows, Dense((size - mean) / sd)), y, len(at) + 1, 1e-3, 300, 0.05)
    slope = float(w[-1] / sd)
    return MetaModel({k: float(w[i]) for (v, k), i in at.items() if v == 0}, {k: float(w[i]) for (v, k), i in at.items() if v == 1}, slope, float(b - slope * mean))


@dataclass(frozen=True)
class Mark:
    """A fitted mark: log-odds = a1 * text + a2 * metadata + bias; None: never."""

    text: TextModel | None
    metadata: MetaModel | None
    a1: float = 0.0
    a2: float = 0.0
    bias: float = -30.0

    def views(self, words: np.ndarray, shape: np.ndarray, source: str | None, lang: str | None, size: float) -> tuple[float, float]:
        return (-30.0, -30.0) if self.text is None else (self.text.odds(words, shape), self.metadata.odds(source, lang, size))

    def probability(self, *features) -> float:
        a, b = self.views(*features)
        return float(sigmoid(np.float64(self.a1 * a + self.a2 * b + self.bias)))


def fit_views(examples: list[Example], mark: str, extra: tuple[dict, dict]) -> Mark:
    """Both views of a mark, calibrated. extra: for each view the examples that the other passed, by key, with their label."""
    known = [e for e in examples if e.y.get(mark) is not None]
    held, train = known[::HELD_OUT], [e for i, e in enumerate(known) if i % HELD_OUT]
    if any(len({e.y[mark] for e in x}) < 2 for x in (held, train)):
        return Mark(None, None)
    sets = [(train + [e for e, _ in more.values()], np.array([e.y[mark] for e in train] + [label for _, label in more.values()], float)) for more in extra]
    text, meta = fit_text(*sets[0]), fit_metadata(*sets[1])
    y = np.array([e.y[mark] for e in held])
    (a1, b1), (a2, b2) = (platt(z, y) for z in (np.array([text.odds(e.words, e.shape) for e in held]), np.array([meta.odds(e.source, e.lang, e.size) for e in held])))
    share = (y.sum() + 1) / (len(y) + 2)
    return Mark(text, meta, a1, a2, b1 + b2 - math.log(share / (1 - share)))


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    """(id, h, words, shape, source, lang, size) of every row."""

    @F.pandas_udf("words binary, shape binary")
    def features_of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"words": [packed(content(t)) for t in texts], "shape": [layout(t).tobytes() for t in texts]})

    text = F.col(f"`{text_col}`")
    size = F.log1p(F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0))) if size_col in docs.columns else F.lit(0.0)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), features_of(text).alias("f"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.greatest(size, F.lit(0.0)).alias("size"))
    return made.select("id", "h", "f.words", "f.shape", "source", "lang", "size")


COLUMNS = ("words", "shape", "source", "lang", "size")


def read_row(words: bytes, shape: bytes, source: str | None, lang: str | None, size: float) -> tuple:
    return unpacked(words), np.frombuffer(shape, np.float32), source, lang, size


def examples_of(made: DataFrame, ids: DataFrame, more: list[str]) -> list[tuple]:
    """(Example, *more) for a bounded table of ids, one for each id, in a fixed order."""
    found = made.join(F.broadcast(ids.withColumnRenamed("id", "of")), F.col("id") == F.col("of")).drop("of")
    one = found.groupBy("id").agg(F.min_by(F.struct("h", *COLUMNS, *more), "h").alias("r")).select("id", "r.*")
    rows = sorted(one.collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), str(r["id"])))
    return [(Example(*read_row(*(r[c] for c in COLUMNS))), r["id"], *(r[c] for c in more)) for r in rows]


def confident(made: DataFrame, labels: DataFrame, id_col: str, marks: dict[str, Mark]) -> DataFrame:
    """(id, mark, view, label): of all documents without labels those that a view is most sure of, AT_MOST for each class."""
    sent = made.sparkSession.sparkContext.broadcast(marks)
    names = [f"p_{m}_{v}" for m in MARKS for v in (0, 1)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[x for m in MARKS for x in sent.value[m].views(*read_row(*r))] for r in zip(*(b.column(c).to_pylist() for c in COLUMNS))]
            p = sigmoid(np.array(out, float).reshape(-1, len(names)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), *(pa.array(p[:, k]) for k in range(len(names)))], ["id", "h", *names])

    kind = made.schema["id"].dataType.simpleString()
    scored = made.filter("id IS NOT NULL").mapInArrow(score, ", ".join([f"id {kind}, h long", *(f"{n} double" for n in names)]))
    sure = scored.filter((F.greatest(*names) >= SURE) | (F.least(*names) <= 1 - SURE))
    free = sure.join(labels.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti")
    free = staged(free.groupBy("h").agg(F.min("id").alias("id"), *(F.max(n).alias(n) for n in names)), "confident")
    picked = None
    for m in MARKS:
        for v in (0, 1):
            for label in (0, 1):
                p = F.col(f"p_{m}_{v}") if label else 1 - F.col(f"p_{m}_{v}")
                top = free.filter(p >= SURE).orderBy(p.desc(), "h").limit(AT_MOST).select("id", F.lit(m).alias("mark"), F.lit(v).alias("view"), F.lit(label).alias("label"))
                picked = top if picked is None else picked.unionByName(top)
    return picked


def fit_on(made: DataFrame, labels: DataFrame, id_col: str, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Mark]:
    """Marks fitted on the features of documents."""
    with scratch(made.sparkSession):
        both = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("q"), F.max("toxic").cast("int").alias("t"))
        chosen = staged(both.orderBy(F.xxhash64("id"), "id").limit(labelled), "labelled")
        examples = []
        for e, _, q, t in examples_of(made, chosen, ["q", "t"]):
            e.y.update(low_quality=None if q is None else int(q == 0), toxic=None if t is None else int(t == 1))
            examples.append(e)
        extra: dict[str, tuple[dict, dict]] = {m: ({}, {}) for m in MARKS}
        for turn in range(rounds + 1):
            marks = {m: fit_views(examples, m, extra[m]) for m in MARKS}
            if turn == rounds or all(k.text is None for k in marks.values()):
                return marks
            picked = staged(confident(made, labels, id_col, marks), "picked")
            taken = {i: e for e, i in examples_of(made, picked.select("id").distinct(), [])}
            for r in sorted(picked.collect(), key=str):
                if r["id"] in taken and marks[r["mark"]].text is not None:
                    extra[r["mark"]][1 - r["view"]].setdefault(r["id"], (taken[r["id"]], r["label"]))
    raise AssertionError("rounds must not be negative")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Mark]:
    with scratch(docs.sparkSession):
        return fit_on(staged(features(docs, id_col, text_col, source_col, lang_col, size_col), "features"), labels, id_col, labelled, rounds)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", marks: dict[str, Mark] | None = None, labelled: int = LABELLED) -> DataFrame:
    """id_col, low_quality, toxic (probabilities) and kept (both under a half) for every row of docs."""
    made = features(docs, id_col, text_col, source_col, lang_col, size_col)
    if marks is None:
        made = staged(made, "features")
        marks = fit_on(made, labels, id_col, labelled)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("low_quality double, toxic double")
    def scores(words: pd.Series, shape: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = [[sent.value[m].probability(*row) for m in MARKS] for row in (read_row(w, s, None if pd.isna(o) else o, None if pd.isna(g) else g, n) for w, s, o, g, n in zip(words, shape, source, lang, size))]
        return pd.DataFrame(out, columns=list(MARKS), dtype=float)

    scored = made.select(F.col("id").alias(id_col), scores(*COLUMNS).alias("s"))
    return scored.select(id_col, F.round("s.low_quality", 6).alias("low_quality"), F.round("s.toxic", 6).alias("toxic"), ((F.col("s.low_quality") < 0.5) & (F.col("s.toxic") < 0.5)).alias("kept"))
