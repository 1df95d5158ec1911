"""Quality classifier: a sparse rule ensemble.

Statistics of each text are taken in one narrow pass. On a bounded sample of labelled rows the driver
grows small boosted trees over the statistics, turns every path from a root into a conjunctive rule,
and fits a logistic model over the rules with a lasso penalty, so most weights are zero. The rules that
remain are compiled into one Spark column expression that scores all rows on the JVM.

Null texts count as empty; empty texts have all statistics zero and are scored like any other. Texts
of any length are read whole. Repeated rows are scored each on its own; a document that stands in several
rows or labels is learned from as often. Of splits that gain alike the first statistic and lowest cut is
taken. Where no labelled row exists, or all have one label, the score is the share of label 1 (0.5 without
labels). A table without rows gives none. Statistics' columns get names that no column of the input has.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwright.llm.common import bytes_of, free_name, unit_hash

#: About so many labelled rows are learned from; the sample is picked by a hash of doc_id.
TRAIN_ROWS = 12_000
TREES, DEPTH, BINS, SHRINK, LASSO = 40, 3, 32, 0.3, 0.002
#: A row is of good quality at this score.
CUT = 0.7
STATS = ["n_words", "word_length", "letters", "capitals", "digits", "marks", "symbols", "bars", "shouts", "lines", "repeats", "distinct"]

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower or beyond ASCII, 2 capital, 3 digit, 4 , . ; : ' " - ?, 5 other symbols, 6 bar, 7 exclamation mark, 8 newline, 9 blank
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[*b"#$%&*@^~<>{}[]=+_/\\`()"]] = 5
_CLASS[[*b",.;:'\"-?"]] = 4
_CLASS[ord("|")], _CLASS[ord("!")], _CLASS[10], _CLASS[[32, 9, 11, 12, 13]] = 6, 7, 8, 9


def text_stats(data: bytes) -> list[float]:
    words = data.split()
    if not words:
        return [0.0] * len(STATS)
    counts = np.zeros(10, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, len(raw), 1 << 22):
        counts += np.bincount(_CLASS[raw[i : i + (1 << 22)]], minlength=10)
    n, ink = len(words), int(counts[:8].sum())
    _, low, up, digit, mark, symbol, bar, shout, line, _ = (float(x) for x in counts)
    return [
        float(np.log1p(n)), ink / n, (low + up) / ink, up / ink, digit / ink, mark / ink, symbol / ink, bar / n,
        shout / n, line / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
    ]


def with_stats(docs: DataFrame, prefix: str, keep_text: bool = False) -> DataFrame:
    """All columns (but text, unless asked for) and one per statistic, named with the prefix. Narrow: no
    shuffle, each row is measured where it is read."""
    keep = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in keep] + [prefix + s for s in STATS]

    def work(batches):
        for batch in batches:
            stats = np.array([text_stats(x) for x in bytes_of(batch)], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(np.ascontiguousarray(stats[:, i])) for i in range(len(STATS)))], names=names)

    schema = T.StructType(keep + [T.StructField(n, T.DoubleType()) for n in names[len(keep) :]])
    return docs.mapInArrow(work, schema)


@dataclass
class Rules:
    """Weighted conjunctions: each rule is a list of (statistic, is_at_most, threshold)."""

    base: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def score(self, prefix: str) -> Column:
        """The model as one expression over the statistics' columns, named with the prefix."""
        total = F.lit(self.base)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for stat, at_most, cut in conditions:
                value = F.col(prefix + STATS[stat])
                test = test & ((value <= F.lit(cut)) if at_most else (value > F.lit(cut)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """One tree by Newton gains over binned statistics: (paths of its nodes, leaf value of each row)."""
    value, paths = np.zeros(len(x)), []
    nodes = [(np.arange(len(x)), ())]
    for level in range(DEPTH + 1):
        following = []
        for rows, path in nodes:
            g, h = grad[rows], hess[rows]
            best = (1e-6, None)
            if level < DEPTH and len(rows) >= 20:
                whole = g.sum() ** 2 / (h.sum() + 1)
                for s, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, s], g, len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, s], h, len(c) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (s, k))
            if best[1] is None:
                value[rows] = g.sum() / (h.sum() + 1)
                continue
            s, k = best[1]
            left = binned[rows, s] <= k
            for side, at_most in ((left, True), (~left, False)):
                if side.any():
                    longer = (*path, (s, at_most, float(cuts[s][k])))
                    paths.append(longer)
                    following.append((rows[side], longer))
        nodes = following
    return paths, value


def _simplest(path: tuple) -> tuple:
    """The tightest bound of each statistic and side, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for s, at_most, cut in path:
        old = bounds.get((s, at_most))
        bounds[s, at_most] = cut if old is None else min(old, cut) if at_most else max(old, cut)
    return tuple((s, m, c) for (s, m), c in sorted(bounds.items()))


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Rules(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], axis=1)
    margin, paths = np.full(len(y), np.log(share / (1 - share))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, value = _grow(x, cuts, binned, y - p, p * (1 - p))
        paths.update(map(_simplest, found))
        margin += SHRINK * value
    rules = sorted(paths)
    z = np.stack([np.logical_and.reduce([x[:, s] <= c if m else x[:, s] > c for s, m, c in r]) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    # lasso logistic regression by accelerated proximal gradient steps; the constant bears no penalty
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    step = 4 * len(y) / (np.linalg.norm(np.column_stack([z, np.ones(len(y))]), 2) ** 2)
    v, vb, t = w, b, 1.0
    for _ in range(400):
        r = (1 / (1 + np.exp(-(z @ v + vb))) - y) / len(y)
        w2 = v - step * (z.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * LASSO, 0)
        b2 = vb - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Rules(float(b), [(r, float(k)) for r, k in zip(rules, w, strict=True) if k])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> Rules:
    """Rules from labelled rows (quality not null) for which `usable` (over doc_id) holds. The sample's
    ids, about train_rows of them, are broadcast: a bound that does not grow with the corpus."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("_y"))
    n = marked.count()
    sample = marked.where(unit_hash(F.col("doc_id")) < F.lit(min(1.0, train_rows / max(n, 1))))
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "s_").toPandas()
    rows = rows.sort_values(["doc_id", "_y", *(f"s_{s}" for s in STATS)])
    return fit(rows[[f"s_{s}" for s in STATS]].to_numpy(), rows["_y"].to_numpy())


def accepted(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of good quality, with all their columns and no others."""
    prefix = free_name(docs.columns, "_s_")
    return with_stats(docs, prefix, keep_text=True).where(rules.score(prefix) >= CUT).select(*docs.columns)


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """All columns but text, with score and predicted, which take the place of columns of these names."""
    docs = docs.drop("score", "predicted")
    prefix = free_name(docs.columns, "_s_")
    out = with_stats(docs, prefix).withColumn("score", rules.score(prefix))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop(*(prefix + s for s in STATS))
