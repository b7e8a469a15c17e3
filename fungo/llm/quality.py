"""Quality by a generalised additive model with pairwise interactions.

Features describe the whole text: how much of it is upper case, digits, marks, blanks,
how words and lines repeat, and so on. Each feature is cut into at most ``BINS`` bins at
quantiles of the training rows. Boosting goes round the features in turn and adds, for
one feature at a time, a shallow tree over its bins (at most ``LEAVES`` leaves, fitted to
the log loss) with a small rate; the sum of a feature's trees is its lookup table. The
``PAIRS`` pairs whose joint bins explain most of what is left get a table of two features
in the same way. A score is a sum of table entries, taken for whole batches at once.

Training reads at most ``SAMPLE`` labelled documents of each class.

Edge cases: a null text is empty; an empty text has features 0 and falls into the lowest
bins. Without labelled rows of both classes each score is the share of label 1 (0 without
labels). Ties and repeated rows are scored row by row; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fungo.llm.common import chunks, labelled_sample, texts, with_column_from_text

SAMPLE = 10_000
BINS = 32
COARSE = 8
LEAVES = 4
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15

NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "blank", "other", "exclaim", "stop",
         "distinct_words", "same_as_last", "pair_repeats", "top_word", "long_word", "log_lines", "dup_lines", "line_words",
         "end_marked", "bar", "all_upper_words", "short_words")


def _byte_classes() -> np.ndarray:
    """One row of 256 flags per class of bytes."""
    sets = [range(65, 91), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], b"#*$%&|<>", (32, *range(9, 14)),
            range(128, 256), b"!", b".?"]
    out = np.zeros((len(sets), 256))
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


CLASSES = _byte_classes()


def features(text: bytes) -> list[float]:
    n, words = len(text), text.split()
    if not words:
        return [0.0] * len(NAMES)
    upper, digit, mark, symbol, blank, other, exclaim, stop = (CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    k = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    lengths = np.fromiter(map(len, words), np.int64, k)
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(n), np.log1p(k), (n - blank) / k, upper / n, digit / n, mark / n, symbol / n, blank / n, other / n, exclaim / k, stop / k,
            len(seen) / k, sum(map(bytes.__eq__, words, words[1:])) / k, 1 - pairs / max(1, k - 1), max(seen.values()) / k, float(np.log1p(lengths.max())),
            np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), k / len(lines), sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines) / len(lines),
            text.count(b"|") / k, sum(map(bytes.isupper, words)) / k, float((lengths <= 2).sum()) / k]


@dataclass
class Model:
    share: float
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for i, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, i], "right")]
        for i, j, ei, ej, t in self.pairs:
            out += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return out

    def scorer(self):
        if not self.edges:
            return lambda items: [self.share] * len(items)
        return lambda items: (1 / (1 + np.exp(-np.clip(self.margins(np.array([features(x) for x in items])), -30, 30)))).tolist()


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values at quantiles of the rows."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) < 2:
        return np.zeros(0)
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return middle
    at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * len(x) / bins)
    return np.unique(middle[np.minimum(at, len(middle) - 1)])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree over ordered bins: cut where the gain is largest until there are ``leaves``."""
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    value = lambda a, b: -(gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            a, b = p
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], p, int(cut[at]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables by cyclic boosting; rows are weighted alike."""
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    share = float(y.mean())
    model = Model(share, float(np.log(share / (1 - share))), [_edges(c, BINS) for c in x.T])
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables):
            if len(t) > 1:
                g, h = slopes()
                step = RATE * np.clip(_tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), LEAVES), -4, 4)
                t += step
                f += step[b]

    coarse = [_edges(c, COARSE) for c in x.T]
    cells = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]
    g, h = slopes()
    found = []
    for i, j in combinations(range(len(coarse)), 2):
        if len(coarse[i]) and len(coarse[j]):
            w = len(coarse[j]) + 1
            n = (len(coarse[i]) + 1) * w
            cell = cells[i] * w + cells[j]
            found.append((-float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + 1)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(found)[:PAIRS]]
    tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(chosen, tables):
            g, h = slopes()
            gs, hs = (np.bincount(cells[i] * t.shape[1] + cells[j], v, t.size).reshape(t.shape) for v in (g, h))
            # a tree of depth two: one cut of the first feature, then one of the second on each side
            cut = int(np.argmax([0, *((gs[:c].sum(0) ** 2 / (hs[:c].sum(0) + 1)).sum() + (gs[c:].sum(0) ** 2 / (hs[c:].sum(0) + 1)).sum() for c in range(1, len(t)))]))
            step = np.zeros_like(t)
            for side in (slice(0, cut), slice(cut, None)):
                if t[side].size:
                    step[side] = _tree(gs[side].sum(0), hs[side].sum(0), 2)
            step = RATE * np.clip(step, -4, 4)
            t += step
            f += step[cells[i], cells[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, tables)]
    return model


def _rows(batches):
    for b in batches:
        items, out = texts(b.column(0)), []
        for i, j in chunks(items):
            out += [features(x) for x in items[i:j]]
        yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, target, sample).mapInArrow(_rows, "y int, x array<double>").toArrow()
    y = np.array(rows.column(0).to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return Model(float(y.mean()) if len(y) else 0.0)
    return train(np.array(rows.column(1).to_pylist()), y)


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` plus the score of every whole text."""
    return with_column_from_text(docs, text, out, "double", model.scorer)
