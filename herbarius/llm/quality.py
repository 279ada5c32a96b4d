"""Quality classifier by co-training of a text-content view and a page-metadata view.

Each view has a logistic model.  In every round each model scores all documents without a
label and hands the ones it is surest of, as pseudo-labels, to the other model, which is
fitted again.  At the end each view is calibrated on labelled documents kept out of training
and the calibrated views are combined by a third logistic model, fitted there as well.

Models are fitted on the driver, on arrays of a fixed size: at most ``max_labelled`` labelled
documents and ``grow`` pseudo-labels per class, view and round, each of a document unlike the
others, so that copies don't crowd them out.  Scoring runs over all rows.
"""

from __future__ import annotations

import operator
import sys
import unicodedata
import warnings
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, slices, stored

LANGS, SOURCES = 16, 64
#: Marks that running text uses.
PLAIN_MARKS = ".,;:'\"-()?«»¿¡’“”–—"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 lower or other letter, 1 upper, 2 digit, 3 space, 4 plain mark, 5 other mark."""
    out = np.full(sys.maxunicode + 1, 5, dtype=np.int8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            out[c] = 1
        elif kind[0] in "LM":
            out[c] = 0
        elif kind[0] == "N":
            out[c] = 2
        elif kind[0] == "Z" or c in range(9, 14):
            out[c] = 3
        elif chr(c) in PLAIN_MARKS:
            out[c] = 4
    return out


def text_view(text: str | None) -> list[float]:
    """Shares of marks, capitals, repeated words and the like; short texts are drawn to zero."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, ch = len(words), len(text)
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=6) if ch else np.zeros(6)
    same = sum(map(operator.eq, words, words[1:]))
    marked = sum(map(_marked, words))
    return [
        np.log1p(n) / 10,
        marked / (n + 5),
        np.sqrt(kinds[5] / (ch + 20)),
        kinds[5] / (ch + 20),
        kinds[1] / (ch + 50),
        np.sqrt(kinds[1] / (ch + 50)),
        kinds[2] / (ch + 100),
        kinds[4] / (ch + 50),
        np.sqrt(same / (n + 5)),
        same / (n + 5),
        (n - len(set(words))) / (n + 5),
        (len(lines) - len(set(lines))) / (len(lines) + 5),
        (ch - kinds[3]) / (n + 5) / 10,
        float(n == 0),
    ]


def _marked(word: str) -> bool:
    """Whether a word is or ends in a mark that running text doesn't use."""
    return not word[-1].isalnum() and word[-1] not in PLAIN_MARKS


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (LANGS + SOURCES + 3)
    out[zlib.crc32(("l" + str(lang)).encode("utf-8", "surrogatepass")) % LANGS] = 1.0
    out[LANGS + zlib.crc32(("s" + str(source)).encode("utf-8", "surrogatepass")) % SOURCES] = 1.0
    size = np.log1p(max(0, n_chars or 0)) / 10
    out[-3:] = [size, size * size, float(n_chars is None)]
    return out


@dataclass
class Logistic:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
    """Newton's method with a quadratic penalty, on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(w, mean, scale)


@dataclass
class Model:
    views: tuple[Logistic, Logistic]
    calibrated: tuple[Logistic, Logistic]
    both: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score by text, by metadata, by both)."""
        parts = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, (text, meta), strict=True)]
        both = self.both.logit(np.column_stack(parts))
        return tuple(1 / (1 + np.exp(-x)) for x in (*parts, both))


def _views(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    """``id, text_view, metadata``: both views of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                _, texts, langs, sources, sizes = (part.column(i).to_pylist() for i in range(5))
                views = [text_view(t) for t in texts]
                meta = [metadata_view(*x) for x in zip(langs, sources, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(views, type=pa.list_(pa.float64())), pa.array(meta, type=pa.list_(pa.float64()))], names=["id", "text_view", "metadata"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), lang_col, source_col, F.col(size_col).cast("long"))
    return chosen.mapInArrow(run, f"id {kind}, text_view array<double>, metadata array<double>")


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["text_view"] for r in rows]), np.array([r["metadata"] for r in rows])


def _held_out(ids: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to train on and rows to calibrate on: of each class every fifth by hash of the id,
    one at least, is for calibration; a class's only row is for both."""
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(f"calibrate {ids[i]}".encode()), str(ids[i])))
    train, held = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
    for label in (0.0, 1.0):
        own = np.array([i for i in order if y[i] == label], dtype=int)
        held[own[::5]] = True
        train[own if len(own) == 1 else np.delete(own, np.arange(0, len(own), 5))] = True
    return train, held


def fit(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    rounds: int = 2,
    grow: int = 500,
    sure: float = 0.97,
    max_labelled: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    size_col: str = "n_chars",
) -> Model | None:
    """Co-train on ``df``; None, with a warning, if its labelled rows aren't of both classes.

    Of the labelled ids those of the smallest hash are taken, at most ``max_labelled``; a
    fifth of each class, one row at least, is kept for calibration.  Of an id with several
    texts one is learned from.  Ids with null or conflicting labels are left out.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter("label = most").select("id", "label")
    sample = stored(usable.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "sample")
    # Labels are joined once: what the executors get of a join stays with them until the driver collects its garbage.
    views = _views(df, id_col, text_col, lang_col, source_col, size_col).withColumn("h", F.xxhash64("text_view", "metadata"))
    views = stored(views.join(F.broadcast(sample), "id", "left"), "views")
    known = views.filter("label is not null").groupBy("id", "label").agg(F.min_by(F.struct("text_view", "metadata"), "h").alias("x")).select("id", "label", "x.*").orderBy("id").collect()
    text, meta = _arrays(known)
    y = np.array([float(r["label"]) for r in known])
    if len(set(y)) < 2:
        warnings.warn("labelled documents of both classes are needed; every score is 1", stacklevel=2)
        discard(views)
        discard(sample)
        return None
    train, held = _held_out([r["id"] for r in known], y)
    data = [[x[train]] for x in (text, meta)]
    targets = [[y[train]], [y[train]]]
    models = [fit_logistic(x[0], t[0]) for x, t in zip(data, targets, strict=True)]
    open_ = views.filter("id is not null and label is null")
    taken: set = set()
    for _ in range(rounds):
        for own in (0, 1):
            p = _score_column(models[own], ("text_view", "metadata")[own])
            scored = open_.select("id", "h", p.alias("p"))
            for label in (1.0, 0.0):
                sure_of = F.col("p") >= sure if label else F.col("p") <= 1 - sure
                # Documents of equal views count once, by their smallest id.
                unlike = scored.filter(sure_of).groupBy("h").agg(F.min("id").alias("id"), F.max("p").alias("p"))
                best = unlike.orderBy(F.desc("p") if label else F.asc("p"), "h").limit(grow + len(taken)).select("h", F.xxhash64("id").alias("k")).collect()
                new = [r for r in best if (own, r["h"]) not in taken][:grow]
                taken.update((own, r["h"]) for r in new)
                if new:
                    # At most ``grow`` literals; all rows of an h have its views.
                    chosen = F.col("h").isin([r["h"] for r in new]) & F.xxhash64("id").isin([r["k"] for r in new])
                    rows = open_.filter(chosen).select("h", "text_view", "metadata").dropDuplicates(["h"]).orderBy("h").collect()
                    data[1 - own].append(_arrays(rows)[1 - own])
                    targets[1 - own].append(np.full(len(rows), label))
        models = [fit_logistic(np.concatenate(x), np.concatenate(t)) for x, t in zip(data, targets, strict=True)]
    discard(views)
    discard(sample)
    logits = [m.logit(x[held]) for m, x in zip(models, (text, meta), strict=True)]
    calibrated = [fit_logistic(z[:, None], y[held], 0.1) for z in logits]
    both = fit_logistic(np.column_stack([c.logit(z[:, None]) for c, z in zip(calibrated, logits, strict=True)]), y[held], 0.1)
    return Model(tuple(models), tuple(calibrated), both)


def _score_column(model: Logistic, view: str):
    """The model's probability as a Spark expression over an array column."""
    slope = model.weights[1:] / model.scale
    shift = float(model.weights[0] - (model.mean * slope).sum())
    weights = F.array(*[F.lit(float(w)) for w in slope])
    logit = F.aggregate(F.zip_with(F.col(view), weights, lambda a, b: a * b), F.lit(shift), lambda a, b: a + b)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def with_scores(df: DataFrame, model: Model | None, names: tuple[str, str, str] = ("text_score", "metadata_score", "score"), text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """``df`` with three more columns: the probability of good quality by text, by metadata
    and by both.  Every row stays; without a model all three are 1."""
    text_at, lang_at, source_at, size_at = (df.columns.index(c) for c in (text_col, lang_col, source_col, size_col))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                if shared.value is None:
                    got = [np.ones(part.num_rows)] * 3
                else:
                    text = np.array([text_view(t) for t in part.column(text_at).to_pylist()])
                    meta = np.array([metadata_view(*x) for x in zip(*(part.column(i).to_pylist() for i in (lang_at, source_at, size_at)), strict=True)])
                    got = shared.value.score(text, meta)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in got)], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


#: Columns that the views are made of, by the names of their options.
COLUMNS = {"text_col": "text", "lang_col": "lang", "source_col": "source", "size_col": "n_chars"}


def quality_scores(df: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """``id, text_score, metadata_score, score, keep`` of every row; ``keep`` says that the
    score is at least ``threshold``.

    Null texts and metadata count as empty ones; null and repeated ids are passed on.  Other
    columns are left out.  Without labelled documents of both classes there is a warning, and
    every score is 1.  ``options`` are those of :func:`fit`.
    """
    model = fit(df, labels, id_col=id_col, **options)
    columns = {k: options.get(k, v) for k, v in COLUMNS.items()}
    scored = with_scores(df.select(id_col, *columns.values()), model, **columns)
    return scored.select(id_col, "text_score", "metadata_score", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``df`` whose score is at least ``threshold``, with all columns."""
    model = fit(df, labels, **options)
    names = tuple(free_name(df, n) for n in ("text_score", "metadata_score", "score"))
    return with_scores(df, model, names, **{k: options.get(k, v) for k, v in COLUMNS.items()}).filter(F.col(names[2]) >= threshold).select(df.columns)
