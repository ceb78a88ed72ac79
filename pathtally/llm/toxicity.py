"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Two readers of the same kind, gated units in both directions whose states attention weighs:

* The character reader reads a word's characters, as learnt vectors, with marks at the word's ends.
  It is trained on the distinct words of the sample to tell those that stand in toxic documents
  beyond chance; its pooled state is the character input of the word.
* The window reader reads windows of 32 words, each a learnt vector of the word (word input; zero
  for words that few documents of the sample have) beside the character input. A logistic unit
  scores the window.

All windows of the whole text are scored, each overlapping the next by half. A last logistic unit
turns the two highest window scores, their mean and the number of windows into the document's score.
A token of more than ``LONG`` characters (text without spaces) stands in the windows as pieces of so
many that overlap by ``OVERLAP``; cuts have no marks.

Training takes a bounded sample (``POSITIVE`` and ``NEGATIVE`` labelled documents, least hashes of
the ids first), whole texts. Which windows of a toxic document are toxic is not known: all are scored
before each round, and the highest ones train as toxic; of other documents all windows train, dealt
over the rounds. A quarter of the sample trains the last unit only, so that it sees scores of
documents that the readers have not learnt. Labels, ids, languages and sources are never inputs.
Without labels of both kinds every score is the share of toxic labels (0 without any).

Null or empty texts count as one empty window. Null ids: scored, not held out. Labels that are
null are left out; if an id has several labels the highest counts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

POSITIVE, NEGATIVE = 1000, 2000
WINDOW, STEP = 32, 16
#: Buckets of characters, sizes of the vectors of characters and words, hidden units of the readers.
CHARS, LETTER, WORD = 1024, 8, 8
HIDDEN_CHARS, HIDDEN = 8, 8
LONG, OVERLAP = 24, 8
#: Documents of the sample that a word with a vector of its own is in.
LEAST_DOCS = 3
#: Standard errors beyond which a word's odds are certain.
LEAST_Z = 2.5
#: Rounds over the words and over the windows; small samples take more, up to MOST times as many.
CHAR_ROUNDS, ROUNDS, MOST = 14, 8, 6
CACHE = 60_000
BATCH = 2048
THRESHOLD = 0.7
SEED = 7
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W_]")
#: Stands where a long token is cut; white space, so that no token has it.
CUT = "\x1f"


def pieces(token: str) -> list[str]:
    """The token, or its overlapping pieces if it is a long one without what ``plain`` takes off."""
    if len(token) <= LONG:
        return [token]
    first, last = INNER.search(token), INNER.search(token[::-1])
    if first is None:
        return [token[:1]]
    core = token[first.start() : len(token) - last.start()]
    starts = range(0, max(1, len(core) - OVERLAP), LONG - OVERLAP)
    return [CUT * (k > 0) + core[k : k + LONG] + CUT * (k + LONG < len(core)) for k in starts]


def tokens(text: str | None) -> list[str]:
    words = text.split() if text else []
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in pieces(w)]


def plain(word: str) -> str:
    """A token in lower case without the marks around it; at most ``LONG`` characters and cuts go in."""
    return word.lower() if word.isalnum() or CUT in word else EDGE.sub("", word.lower())


def spelling(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the characters of plain words, one after the other, and where each word starts and the last ends.

    Words are between the buckets 1 and 2, but not where they are cut.
    """
    text = "\2" + "\3\n\2".join(words) + "\3\n"
    if CUT in text:
        text = text.replace("\2" + CUT, "").replace(CUT + "\3", "")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 10
    buckets = np.where((codes == 2) | (codes == 3), codes - 1, 3 + codes % np.uint32(CHARS - 3)).astype(np.int32)[~ends]
    return buckets, np.concatenate([[0], np.flatnonzero(ends) - np.arange(int(ends.sum()))])


def spelt_rows(buckets: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(words, longest) of the buckets of some words, 0 behind their ends."""
    n = starts[own + 1] - starts[own]
    at = starts[own][:, None] + np.arange(max(1, int(n.max(initial=1))))
    return np.where(at < starts[own + 1][:, None], buckets[np.minimum(at, len(buckets) - 1)], 0)


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last reaches the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def framed(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of a text's rows, 0 where there is no word."""
    ids = np.pad(ids, (0, max(0, WINDOW - len(ids))))
    return ids[np.array(windows(len(ids)))[:, None] + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Reader:
    """Gated recurrent units in both directions and attention over their states."""

    def __init__(self, features: int, hidden: int, r: np.random.Generator):
        self.hidden, self.p = hidden, {}
        for d in "fb":
            self.p[f"W{d}"] = (r.normal(size=(features, 3 * hidden)) * features**-0.5).astype(np.float32)
            self.p[f"U{d}"] = (r.normal(size=(hidden, 3 * hidden)) * hidden**-0.5).astype(np.float32)
        self.p["v"] = (r.normal(size=2 * hidden) * 0.3).astype(np.float32)

    def pad_row(self) -> np.ndarray:
        """Projection of nothing: the update gate keeps the state."""
        return np.concatenate([np.full(self.hidden, 30), np.zeros(2 * self.hidden)]).astype(np.float32)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] for d in "fb"}

    def states(self, rows, steps: int, d: str, keep: bool = False):
        """(n, steps, hidden) of one direction. ``rows(t)``: projections of the t-th inputs."""
        U, H = self.p[f"U{d}"], self.hidden
        h, out, kept = None, [None] * steps, {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = rows(t)
            if h is None:
                h = np.zeros((len(g), H), g.dtype)
            a = h @ U
            zr = sigmoid(g[:, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(g[:, 2 * H :] + r * a[:, 2 * H :])
            if keep:
                kept[t] = h, z, r, c, a[:, 2 * H :]
            h = c + z * (h - c)
            out[t] = h
        return np.stack(out, 1), kept

    def pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = states @ self.p["v"] + np.where(real, np.float32(0), np.float32(-30))
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        return a, (a[:, :, None] * states).sum(1)

    def read(self, tables: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """(n, 2 * hidden). ids: (n, steps) rows of the projection tables, 0 for none."""
        both = np.concatenate([self.states(lambda t, d=d: tables[d][ids[:, t]], ids.shape[1], d)[0] for d in "fb"], 2)
        return self.pooled(both, ids > 0)[1]

    def forward(self, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
        """As ``read`` from inputs (n, steps, features), with what ``backward`` needs."""
        pad, steps = self.pad_row(), x.shape[1]
        proj = {d: np.where(real[:, :, None], x @ self.p[f"W{d}"], pad) for d in "fb"}
        runs = {d: self.states(lambda t, d=d: proj[d][:, t], steps, d, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        a, pooled = self.pooled(both, real)
        return pooled, (x, real, runs, both, a)

    def backward(self, kept: tuple, dp: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, by back-propagation through time."""
        x, real, runs, both, a = kept
        H, steps = self.hidden, x.shape[1]
        da = (both * dp[:, None, :]).sum(2)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        g = {"v": (ds[:, :, None] * both).sum((0, 1))}
        dboth = a[:, :, None] * dp[:, None, :] + ds[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            W, U, own = self.p[f"W{d}"], self.p[f"U{d}"], runs[d][1]
            dW, dU, dh = np.zeros_like(W), np.zeros_like(U), np.zeros((len(x), H), x.dtype)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                dh = dh + dboth[:, t, i * H : (i + 1) * H]
                h, z, r, c, ac = own[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1) * real[:, t, None]
                dag = np.concatenate([dz, dr, dc * r], 1)
                dW += x[:, t].T @ dg
                dU += h.T @ dag
                dx[:, t] += dg @ W.T
                dh = dh * z + dag @ U.T
            g[f"W{d}"], g[f"U{d}"] = dW, dU
        return g, dx


class Unit:
    """A reader with a table of vectors before it and a logistic unit behind it."""

    def __init__(self, rows: int, width: int, more: int, hidden: int, r: np.random.Generator):
        self.reader = Reader(width + more, hidden, r)
        self.table = (r.normal(size=(rows, width)) * 0.3).astype(np.float32)
        self.last = {"w": (r.normal(size=2 * hidden) * 0.3).astype(np.float32), "c": np.zeros(1, np.float32)}

    def params(self) -> dict[str, np.ndarray]:
        return {**self.reader.p, **self.last, "table": self.table}

    def gradients(self, ids: np.ndarray, more: np.ndarray | None, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients. ids: (n, steps) rows of the table; more: further inputs (n, steps, features)."""
        x = self.table[ids] if more is None else np.concatenate([self.table[ids], more], 2)
        pooled, kept = self.reader.forward(x, real)
        out = sigmoid(pooled @ self.last["w"] + self.last["c"])
        loss = -np.mean(weight * (y * np.log(out + 1e-7) + (1 - y) * np.log(1 - out + 1e-7)))
        do = (weight * (out - y) / len(y)).astype(x.dtype)
        g, dx = self.reader.backward(kept, do[:, None] * self.last["w"])
        width = self.table.shape[1]
        flat = ids.reshape(-1)
        order = np.argsort(flat, kind="stable")
        firsts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        dt = np.zeros_like(self.table)
        dt[flat[order][firsts]] = np.add.reduceat(dx.reshape(len(flat), -1)[order, :width], firsts)
        return float(loss), {**g, "w": pooled.T @ do, "c": np.array([do.sum()], x.dtype), "table": dt}

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.last["w"] + self.last["c"]


def adam(params: dict, epochs, rate: float, decay: float = 0.0) -> None:
    """Adam over batches; ``epochs`` yields gradients. ``decay`` shrinks the tables of vectors."""
    m, v = {k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()}
    for step, g in enumerate(epochs, 1):
        for k in params:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(params[k].dtype)
            if k == "table" and decay:
                params[k] *= params[k].dtype.type(1 - decay)


class Model:
    """All that scoring needs; small enough to travel with each task."""

    def __init__(self, chars: Unit | None, words: Unit | None, names: dict[str, int], last: np.ndarray, constant: float | None = None):
        self.chars, self.words, self.names, self.last, self.constant = chars, words, names, last, constant

    def spelt(self, words: list[str]) -> np.ndarray:
        """Pooled states of the character reader for plain words."""
        reader = self.chars.reader
        tables = {d: np.concatenate([reader.pad_row()[None], t]) for d, t in reader.project(self.chars.table).items()}
        out = np.zeros((len(words), 2 * reader.hidden), np.float32)
        if not words:
            return out
        buckets, starts = spelling(words)
        order = np.argsort(np.diff(starts), kind="stable")
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            ids = spelt_rows(buckets, starts, own)
            # row 0 of the tables is no character
            out[own] = reader.read(tables, np.where(ids > 0, ids + 1, 0))
        return out

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of plain words: word vector and character input."""
        own = self.words.table[np.fromiter((self.names.get(w, 0) for w in words), np.int32, len(words))]
        return np.concatenate([own, self.spelt(words)], 1)

    @staticmethod
    def summary(logits: np.ndarray) -> list[float]:
        top = np.sort(logits)[::-1]
        second = top[1] if len(top) > 1 else -8.0
        return [float(np.clip(top[0], -12, 12)) / 4, float(np.clip(second, -12, 12)) / 4, float(np.mean(sigmoid(logits))), float(np.log(len(top))) / 4, 1.0]


class Scorer:
    """Scores batches of texts; keeps the projections of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            self.reset()

    def reset(self) -> None:
        reader = self.model.words.reader
        self.ids: dict[str, int] = {}  # rows of tokens, and of their plain forms
        self.plain: dict[str, int] = {}
        self.tables = {d: np.tile(reader.pad_row(), (1, 1)) for d in "fb"}
        self.used = 1

    def add(self, fresh: list[str]) -> None:
        """Rows for tokens not met before; tokens of one plain form share a row."""
        forms = [plain(w) for w in fresh]
        words = [w for w in dict.fromkeys(forms) if w not in self.plain]
        if words:
            self.plain.update(zip(words, range(self.used, self.used + len(words)), strict=True))
            for d, rows in self.model.words.reader.project(self.model.inputs(words)).items():
                if self.used + len(rows) > len(self.tables[d]):
                    grown = np.empty((3 * (self.used + len(rows)) // 2, rows.shape[1]), np.float32)
                    grown[: self.used] = self.tables[d][: self.used]
                    self.tables[d] = grown
                self.tables[d][self.used : self.used + len(rows)] = rows
            self.used += len(words)
        self.ids.update(zip(fresh, map(self.plain.__getitem__, forms), strict=True))

    def logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text, the scores of all its windows."""
        if len(self.plain) > CACHE:
            self.reset()
        elif len(self.ids) > 2 * CACHE:
            self.ids.clear()
        split = [tokens(text) for text in texts]
        fresh = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.ids]
        if fresh:
            self.add(fresh)
        rows = [framed(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))) for words in split]
        ids = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32)
        tables, own = {d: t[: self.used] for d, t in self.tables.items()}, self.model.words
        out = [own.logits(own.reader.read(tables, ids[k : k + BATCH])) for k in range(0, len(ids), BATCH)]
        return np.split(np.concatenate(out), np.cumsum([len(x) for x in rows])[:-1]) if out else []

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model.constant is not None:
            return [self.model.constant] * len(texts)
        found = np.array([Model.summary(x) for x in self.logits(texts)]).reshape(-1, 5)
        return sigmoid(found @ self.model.last).tolist()


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    return np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


def rounds(least: int, usual: int, n: int) -> int:
    """Rounds over n examples: ``least`` from ``usual`` examples on."""
    return int(least * min(MOST, max(1, usual / max(1, n))))


def spelling_lessons(unit: Unit, words: list[str], alarming: np.ndarray, r: np.random.Generator) -> Iterator[dict]:
    """Gradients of the character reader over distinct words, batches of like lengths."""
    weight = balanced(alarming)
    buckets, starts = spelling(words)
    by_length = np.argsort(np.diff(starts), kind="stable")
    batches = [by_length[k : k + 256] for k in range(0, len(by_length), 256)]
    for _ in range(rounds(CHAR_ROUNDS, 30_000, len(words))):
        for k in r.permutation(len(batches)):
            own = batches[k]
            ids = spelt_rows(buckets, starts, own)
            yield unit.gradients(ids, None, ids > 0, alarming[own], weight[own])[1]


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fits readers and the last unit. Deterministic."""
    if len(set(toxic)) < 2:
        return Model(None, None, {}, np.zeros(5), constant=float(np.mean(toxic)) if toxic else 0.0)
    r = np.random.default_rng(SEED)
    place = r.permutation(len(texts))
    learnt = [k for k in range(len(texts)) if place[k] % 4] if len(texts) >= 40 else list(range(len(texts)))
    if len({toxic[k] for k in learnt}) < 2:
        learnt = list(range(len(texts)))
    rest = sorted(set(range(len(texts))) - set(learnt))
    if len({toxic[k] for k in rest}) < 2:
        rest = learnt

    # distinct plain words and the documents that they are in
    split = [[plain(w) for w in tokens(texts[k])] for k in learnt]
    y = np.array([toxic[k] for k in learnt], np.float32)
    seen, bad = Counter(), Counter()
    for words, label in zip(split, y, strict=True):
        seen.update(set(words))
        if label:
            bad.update(set(words))
    types = sorted(seen)
    known = [w for w in types if seen[w] >= LEAST_DOCS]
    n, a = np.array([seen[w] for w in known], np.float32), np.array([bad[w] for w in known], np.float32)
    odds = np.log((a + 0.5) / (y.sum() + 1)) - np.log((n - a + 0.5) / (len(y) - y.sum() + 1))
    certain = np.abs(odds) >= LEAST_Z * np.sqrt(1 / (a + 0.5) + 1 / (n - a + 0.5))
    chars = Unit(CHARS, LETTER, 0, HIDDEN_CHARS, r)
    adam(chars.params(), spelling_lessons(chars, known, (certain & (odds > 0)).astype(np.float32), r), 0.02)

    names = {w: k for k, w in enumerate(known, 1)}
    words = Unit(1 + len(names), WORD, 2 * HIDDEN_CHARS, HIDDEN, r)
    words.table[:] *= 0.1
    words.table[0] = 0
    # vectors start from the odds where these are certain; the lessons go on from there
    words.table[1:, 0] = np.where(certain, odds / 4, 0)
    model = Model(chars, words, names, np.zeros(5))
    index = {w: k for k, w in enumerate(types, 1)}
    spelt = np.concatenate([np.zeros((1, 2 * HIDDEN_CHARS), np.float32), model.spelt(types)])
    named = np.array([0, *(names.get(w, 0) for w in types)], np.int32)
    frames = [framed(np.fromiter((index[w] for w in ws), np.int32, len(ws))) for ws in split]
    good = np.concatenate([f for f, label in zip(frames, y, strict=True) if not label])
    toxics = [f for f, label in zip(frames, y, strict=True) if label]
    alarm = chars.logits(spelt)

    def scored(ids: np.ndarray, turn: int) -> np.ndarray:
        """Scores of windows: by their most alarming words at first, then by the reader."""
        if not turn:
            return np.sort(np.where(ids > 0, alarm[ids], -8), 1)[:, -4:].sum(1)
        x = np.concatenate([words.table[named], spelt], 1)
        tables = {d: t for d, t in words.reader.project(x).items()}
        for t in tables.values():
            t[0] = words.reader.pad_row()
        return np.concatenate([words.logits(words.reader.read(tables, ids[k : k + BATCH])) for k in range(0, len(ids), BATCH)])

    def lessons() -> Iterator[dict]:
        parts = np.array_split(r.permutation(len(good)), max(1, min(len(good) // 2000, ROUNDS // 2)))
        for turn in range(rounds(ROUNDS, 40_000, len(good))):
            some = []
            for f, s in zip(toxics, np.split(scored(np.concatenate(toxics), turn), np.cumsum([len(f) for f in toxics])[:-1]), strict=True):
                # the highest window, and others that look toxic by now
                top = np.argsort(-s, kind="stable")
                some.append(f[top[: max(1, int((s > 1).sum()) if turn > 1 else min(2, len(top)))]])
            x = np.concatenate([*some, good[parts[turn % len(parts)]]])
            label = np.zeros(len(x), np.float32)
            label[: sum(map(len, some))] = 1
            weight = balanced(label)
            order = r.permutation(len(x))
            for k in range(0, len(order), 256):
                b = order[k : k + 256]
                ids = x[b]
                rows = np.where(r.random(ids.shape) < 0.2, 0, named[ids])  # words without their vectors, as new words are
                yield words.gradients(rows, spelt[ids], ids > 0, label[b], weight[b])[1]

    adam(words.params(), lessons(), 0.005, decay=1e-3)
    words.table[0] = 0
    scorer = Scorer(model)
    summaries = np.array([Model.summary(z) for at in range(0, len(rest), 200) for z in scorer.logits([texts[k] for k in rest[at : at + 200]])])
    target = np.array([toxic[k] for k in rest], float)
    last = {"b": np.zeros(5)}

    def descents() -> Iterator[dict]:
        for _ in range(1500):
            yield {"b": summaries.T @ (sigmoid(summaries @ last["b"]) - target) / len(target) + 1e-4 * last["b"]}

    adam(last, descents(), 0.05)
    model.last = last["b"]
    return model


def held_out(id_col) -> F.Column:
    """Whether labels of the id may not be learnt from: crc32 of its text mod 3 is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The labelled training sample: a bounded number of ids, then their whole texts."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").where("text is not null"), "doc_id", "left_semi")
    some = None
    for wanted, most in (("toxic > 0", POSITIVE), ("toxic <= 0", NEGATIVE)):
        part = known.where(wanted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.union(part)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")  # POSITIVE + NEGATIVE rows
    rows = sorted({(r.doc_id, r.text, int(r.toxic > 0)) for r in rows.collect()})
    return [t for _, t, _ in rows], [y for *_, y in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score below ``THRESHOLD``, all columns."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in common.trimmed(parts):
            own = [t if isinstance(t, str) else None for t in texts]
            yield pd.Series([s for k in range(0, len(own), 200) for s in scorer.scores(own[k : k + 200])], dtype="float64")

    return docs.where(scored(F.col(text_col).cast("string")) < THRESHOLD)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row: a map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.trimmed(batches):
            texts = batch.column(2).to_pylist()
            got = [s for k in range(0, len(texts), 200) for s in scorer.scores(texts[k : k + 200])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(s >= THRESHOLD) for s in got], pa.int32())],
                names=[batch.schema.names[0], "held_out", "score", "predicted"],
            )

    given = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
