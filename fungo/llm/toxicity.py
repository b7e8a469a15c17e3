"""Toxicity by a subsequence string-kernel support vector machine.

Two words are compared by the gap-weighted subsequence kernel: every three characters
that occur in both in the same order count, each occurrence with ``DECAY`` to the power
of the characters it spans. An insult with inserted or missing characters therefore
stays close to its plain form. Punctuation inside a word is dropped, digits that stand
for letters are read as letters, and single characters separated by blanks are read
together, before the kernel is applied.

A sentence is compared with a landmark word by its closest word. Nystroem features are
these similarities, made steep around ``HALF`` so that chance likenesses count little, to
at most ``LANDMARKS`` words of the training sentences, whitened by the landmarks' own kernel matrix. A linear SVM on them (squared hinge, Newton steps) is
trained on sentences, which take the label of their document; of a toxic document only
the sentence that now scores highest stays positive, and training is repeated until that
choice settles. A document's score is a logistic curve, fitted to training documents, of
its highest sentence margin and of how many of its sentences, at most ``BAG``, lie above the margins
0 and -0.5: words that merely resemble an insult turn up once, insults are repeated.

Training reads at most ``SAMPLE`` labelled documents of each class and the ``BAG``
sentences of each that come closest to a landmark. Scoring reads every whole text.

Edge cases: a null or empty text, or one without words of three letters, has no similar
sentence and takes the score of the empty sentence. Without labelled rows of both
classes every score is the share of label 1 (0 without labels). Repeated rows and ties
are scored row by row; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fungo.llm.common import chunks, labelled_sample, stored, texts, with_column_from_text

DECAY = 0.6
SPAN = 8
WINDOW = 20
SAMPLE = 3000
BAG = 12
LANDMARKS = 64
FLOOR = 0.25
POWER = 8
HALF = 0.75
MEMO = 200_000

# Characters commonly written for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _tables() -> tuple[bytes, bytes, np.ndarray]:
    to, drop, code = bytearray(range(256)), [], np.zeros(256, np.int32)
    for b in range(128):
        c = chr(b)
        if c in LOOKALIKE:
            to[b] = ord(LOOKALIKE[c])
        elif not c.isalpha() and not c.isspace() and b > 3:
            drop.append(b)
    for b in range(26):
        code[ord("a") + b] = b + 1
    code[3] = 31
    code[128:] = 27 + np.arange(128) % 4
    return bytes(to), bytes(drop), code


def sharp(k: np.ndarray) -> np.ndarray:
    """Similarities from 0 to 1 that rise steeply around ``HALF``."""
    k = np.maximum(k, 0).astype(np.float32) ** POWER
    return k / (k + np.float32(HALF ** POWER))


TO, DROP, CODE = _tables()
SPACED = re.compile(rb" (?:\S ){4,}")


def _combos(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples i < j < k within SPAN of a word of ``length``, and their weights."""
    at = np.array([(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN)) for k in range(j + 1, min(length, i + SPAN))],
                  np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def windows(word: bytes) -> list[bytes]:
    """The word behind a mark of its start; a long word as overlapping windows."""
    word = b"\x03" + word
    n = len(word)
    if n <= WINDOW:
        return [word] if n > 3 else []
    return [word[i:i + WINDOW] for i in range(0, n - WINDOW // 2, WINDOW // 2)]


COMBOS = {n: _combos(n) for n in range(3, WINDOW + 1)}
NORM = {n: float(np.sqrt((w ** 2).sum())) for n, (_, w) in COMBOS.items()}


def plain(text: bytes) -> list[bytes]:
    """Words of a text as the kernel reads them; ``\\x01`` stands between sentences."""
    text = SPACED.sub(lambda m: b" " + m[0].replace(b" ", b"") + b" ", b" " + text.lower() + b" ")
    for end in (b". ", b"! ", b"? ", b"\n"):
        text = text.replace(end, b" \x01 ")
    return text.translate(TO, DROP).split()


class Kernel:
    """Similarities of words to landmark words, normalised to about 1 for equal words."""

    def __init__(self, landmarks: list[bytes]):
        self.m = len(landmarks)
        rows: dict[int, np.ndarray] = {}
        for j, word in enumerate(landmarks):
            word = windows(word)[0]
            at, w = COMBOS[len(word)]
            code = CODE[np.frombuffer(word, np.uint8)]
            own: dict[int, float] = {}
            for key, x in zip((code[at] @ np.array([1024, 32, 1])).tolist(), w.tolist()):
                own[key] = own.get(key, 0.0) + x
            norm = np.sqrt(sum(x * x for x in own.values()))
            for key, x in own.items():
                rows.setdefault(key, np.zeros(self.m, np.float32))[j] = x / norm
        self.weight = np.stack([np.zeros(self.m, np.float32), *rows.values()])
        self.most = self.weight.max(axis=1)
        self.place = np.zeros(1 << 15, np.int32)
        for i, key in enumerate(rows):
            self.place[key] = i + 1

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """One row of similarities a word; rows that stay below FLOOR are 0."""
        out = np.zeros((len(words), self.m), np.float32)
        pieces: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, word in enumerate(words):
            for part in windows(word):
                own, parts = pieces.setdefault(len(part), ([], []))
                own.append(i)
                parts.append(part)
        for n, (own, parts) in pieces.items():
            at, w = COMBOS[n]
            for lo in range(0, len(parts), 4096):
                code = CODE[np.frombuffer(b"".join(parts[lo:lo + 4096]), np.uint8).reshape(-1, n)]
                place = self.place[(code[:, at[:, 0]] << 10) + (code[:, at[:, 1]] << 5) + code[:, at[:, 2]]]
                near = np.flatnonzero(self.most[place] @ w >= FLOOR * NORM[n])  # an upper bound of each similarity
                for k in range(0, len(near), 256):
                    rows = near[k:k + 256]
                    row, combo = np.nonzero(place[rows])
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    sums = np.add.reduceat(self.weight[place[rows][row, combo]] * w[combo, None], first, axis=0) / NORM[n]
                    for i, v in zip(np.array(own[lo:lo + 4096])[rows], sums):
                        np.maximum(out[i], v, out=out[i])
        out[out.max(axis=1, initial=0) < FLOOR] = 0
        return out


class Sentences:
    """Similarity rows of the sentences of texts. Words below FLOOR everywhere count as nothing."""

    def __init__(self, landmarks: list[bytes]):
        self.kernel = Kernel(landmarks)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"\x01": -1, b"\x02": -2}
        self.rows = np.zeros((1, self.kernel.m), np.float32)

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.forget()
            new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            k = self.kernel(new)
            near = np.flatnonzero(k.max(axis=1) >= FLOOR)
            self.known.update(dict.fromkeys(new, 0))
            self.known.update(zip((new[i] for i in near), range(len(self.rows), len(self.rows) + len(near))))
            self.rows = np.concatenate([self.rows, k[near]])

    def __call__(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document of each sentence that has a near word, its similarities; sentences of each document."""
        words: list[bytes] = []
        for x in items:
            words += plain(x)
            words.append(b"\x02")
        self.learn(words)
        known = self.known
        ids = np.array([known[w] for w in words], np.int64)
        sentence, doc = np.cumsum(ids < 0), np.cumsum(ids == -2)
        size = np.diff(np.r_[0, sentence[ids == -2]])
        at = np.flatnonzero(ids > 0)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, self.kernel.m), np.float32), size
        first = np.flatnonzero(np.r_[True, np.diff(sentence[at]) > 0])
        return doc[at[first]], sharp(np.maximum.reduceat(self.rows[ids[at]], first, axis=0)), size


@dataclass
class Model:
    landmarks: list[bytes]
    weight: np.ndarray
    bias: float
    curve: np.ndarray
    share: float

    def scorer(self):
        if not self.landmarks:
            return lambda items: [self.share] * len(items)
        sentences = Sentences(self.landmarks)

        def run(items: list[bytes]) -> list[float]:
            doc, k, size = sentences(items)
            return _curve(evidence(doc, k @ self.weight + self.bias, size, self.bias) @ self.curve).tolist()

        return run


def evidence(doc: np.ndarray, margin: np.ndarray, size: np.ndarray, bias: float) -> np.ndarray:
    """Of each document: its highest margin, how many sentences lie above 0 and above -0.5, and their share; then 1."""
    best = np.full(len(size), bias)
    np.maximum.at(best, doc, margin)
    best = np.clip(best, -3, 3)
    over, close = (np.minimum(np.bincount(doc[margin > least], minlength=len(size)), BAG) for least in (0, -0.5))
    share = np.minimum(1, 8 * over / np.maximum(size, 8))
    return np.c_[best, np.log1p(over), np.log1p(close), share, np.ones(len(size))]


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _word_counts(batches):
    """(word, documents of label 1, of label 0) of a task's documents."""
    counts: dict[bytes, list[int]] = {}

    def rows():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in (1, 0))], ["word", "pos", "neg"])

    for b in batches:
        for text, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
            for w in set(plain(text)):
                if len(w) > 2:
                    counts.setdefault(w, [0, 0])[y] += 1
        if len(counts) > 500_000:
            yield rows()
            counts.clear()
    yield rows()


def choose_landmarks(sample: DataFrame, n: tuple[int, int], limit: int = LANDMARKS) -> list[bytes]:
    """Words that tell the classes apart (at most 7/8), then common words, none too close to another."""
    words = sample.mapInArrow(_word_counts, "word binary, pos bigint, neg bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p1, p0 = (F.col("pos") + 0.5) / (n[1] + 1), (F.col("neg") + 0.5) / (n[0] + 1)
    pooled = (F.col("pos") + F.col("neg") + 1) / (n[0] + n[1] + 2)
    words = words.select("word", "pos", "neg", ((p1 - p0) / F.sqrt(pooled * (1 - pooled) + 1e-9)).alias("lift"), (p1 / p0).alias("ratio"))
    telling = words.where("pos >= 2 and ratio >= 3").orderBy(F.desc("lift"), "word").limit(6 * limit).collect()
    common = words.orderBy(F.desc("neg"), "word").limit(limit).collect()
    out: list[bytes] = []
    for rows, upto in ((telling, limit * 7 // 8), (common, limit)):
        for r in rows:
            w = bytes(r.word)[:WINDOW - 1]
            if len(out) < upto and w not in out and (not out or Kernel(out)([w]).max() < 0.9):
                out.append(w)
    return out


def _bags(landmarks: list[bytes], batches):
    """The BAG closest sentences of each document, as packed floats."""
    sentences = Sentences(landmarks)
    for b in batches:
        items, ys, bags, sizes, all_sizes = texts(b.column(0)), b.column(1).to_pylist(), [], [], []
        for i, j in chunks(items):
            doc, k, size = sentences(items[i:j])
            all_sizes += size.tolist()
            near = k.max(axis=1) if len(k) else np.zeros(0)
            order = np.lexsort((-near, doc))
            for d in range(j - i):
                own = order[np.searchsorted(doc, d):np.searchsorted(doc, d, "right")][:BAG]
                bags.append(k[own].astype("<f4").tobytes())
                sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(sizes, pa.int32()), pa.array(all_sizes, pa.int32()), pa.array(bags, pa.binary())], ["y", "n", "size", "bag"])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 30) -> np.ndarray:
    """Weights, the bias last, that minimise |w|^2 / 2 plus cost times the mean squared hinge."""
    x = np.c_[x, np.ones(len(x))]
    w, s = np.zeros(x.shape[1]), np.where(y > 0, 1.0, -1.0)
    scale = cost * weight / weight.sum() * 100
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(steps):
        gap = 1 - s * (x @ w)
        on = gap > 0
        xa = x[on] * scale[on, None]
        new = w - np.linalg.solve(xa.T @ x[on] + np.diag(ridge), ridge * w - xa.T @ (s * gap)[on])
        if np.abs(new - w).max() < 1e-8:
            return new
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve, lightly bounded; none but the last is negative."""
    use = np.ones(x.shape[1], bool)
    while True:
        b = np.zeros(x.shape[1])
        for _ in range(50):
            p = _curve(x @ b)
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
            step = np.zeros(len(b))
            step[use] = np.linalg.solve(h[np.ix_(use, use)], (x.T @ (p - y) + 0.05 * b)[use])
            b = b - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        low = np.flatnonzero(b[:-1] < 0)
        if not len(low):
            return b
        use[low] = False


def train(landmarks: list[bytes], k: np.ndarray, doc: np.ndarray, y: np.ndarray, size: np.ndarray, share: float) -> Model:
    """Model of sentence similarities ``k`` whose documents ``doc`` have labels ``y`` and ``size`` sentences."""
    m = len(landmarks)
    order = np.lexsort((*k.T[::-1], doc, y[doc]))  # the same order whatever the order of rows
    k, doc = k[order], doc[order]

    own = sharp(Kernel(landmarks)(landmarks)).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    x = k @ whiten.astype(np.float32)
    w = np.zeros(m + 1)
    positive = y[doc] == 1
    start = k[:, : max(1, m * 7 // 8)].max(axis=1) if len(k) else np.zeros(0)
    chosen = None
    for turn in range(8):
        score = start if turn == 0 else x @ w[:-1]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, score)
        witness = positive & (score == best[doc])
        if chosen is not None and (witness == chosen).all():
            break
        chosen = witness
        use = witness | ~positive
        empty = np.array([(y == 1).sum() - len(set(doc[witness])), (y == 0).sum()])  # documents without a near sentence
        xs = np.r_[x[use], np.zeros((1, m))]
        ys = np.r_[witness[use].astype(int), 0]
        weight = np.where(ys == 1, 1 / max(1, ys.sum()), 1 / max(1, (1 - ys).sum() + empty[1]))
        weight[-1] *= max(1, empty[1])
        w = _svm(xs, ys, weight)
    direct, bias = whiten @ w[:-1], float(w[-1])
    curve = _logistic(evidence(doc, k @ direct + bias, size, bias), y)
    return Model(landmarks, direct, bias, curve, share)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = stored(labelled_sample(docs, labels, target, sample), "toxicity-sample")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    landmarks = choose_landmarks(rows, (n[0], n[1])) if len(n) == 2 else []
    if not landmarks:
        return Model([], np.zeros(0), 0.0, np.zeros(0), share)
    bags = rows.mapInArrow(partial(_bags, landmarks), "y int, n int, size int, bag binary").collect()
    m = len(landmarks)
    k = np.frombuffer(b"".join(bytes(b.bag) for b in bags), "<f4").reshape(-1, m)
    doc = np.repeat(np.arange(len(bags)), [b.n for b in bags])
    return train(landmarks, k, doc, np.array([b.y for b in bags]), np.array([b.size for b in bags]), share)


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` plus the score of every whole text."""
    return with_column_from_text(docs, text, out, "double", model.scorer)
