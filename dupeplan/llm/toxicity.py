"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of its hashed form beside the mean embedding of
its hashed character trigrams. Two gated recurrent layers read a window of words
from either side, attention pools their states, and a logistic unit scores the
window. A text is scored by all its overlapping windows; the largest score,
calibrated on documents that trained nothing else, is the text's.

The network is trained in numpy on the driver, from at most ``SAMPLE`` toxic
and ``CLEAN`` times as many clean rows (those with the smallest hashed keys, of
texts of up to ``LONGEST`` bytes): first on random windows
that inherit their document's label, then on the windows that score most in
each document. Embeddings of words and trigrams that few of the documents hold
stay zero, so that no document is learnt by heart.

Null and empty texts score what no word says (the network's bias, trained to be clean). Repeated
rows, null keys and very long texts are scored like any others; other columns are ignored. Without labels of both classes
every score is the share of toxic labels (0 without any). An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import LETTERS, bound_batches, chunks, hashed_sample, words_of

#: Toxic labelled rows that may train and calibrate the network.
SAMPLE = 1000
#: Windows of a document in the first round of training, and rounds.
PER_TEXT, ROUNDS = 6, 4
#: Documents that must hold a word or trigram for its embedding to be used.
SEEN = 8
#: Decay of embeddings for each step, as a share of the learning rate.
DECAY = 0.1
#: Steps that a round of training takes at least, however few its windows.
STEPS = 80
#: Clean rows for each toxic one that may train.
CLEAN = 2
#: Bytes of the longest text that may train; with the bound on rows it bounds what the driver receives.
LONGEST = 1 << 16
WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
#: Text bytes of a chunk that is scored at once.
CHUNK = 2 << 20


class Vocabulary:
    """Hashed inputs of distinct words: a bucket for each word and the buckets of its trigrams."""

    def __init__(self, words: list[bytes]):
        marked = [b"<" + w + b">" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        grams = (data[:-2] * 65536 + data[1:-1] * 256 + data[2:]) if len(data) > 2 else np.zeros(0, np.uint32)
        inside = np.ones(len(data), bool)
        inside[ends - 1] = inside[ends - 2] = False
        with np.errstate(over="ignore"):
            hashed = (grams * np.uint32(2654435761)) >> np.uint32(16)
            rolled = np.cumsum(data.astype(np.uint64) * np.cumprod(np.full(len(data), 1099511628211, np.uint64)))
            before = np.where(starts > 0, rolled[starts - 1], 0) if len(starts) else np.zeros(0, np.uint64)
            inverse = np.uint64(pow(1099511628211, -1, 1 << 64))
            back = np.cumprod(np.full(len(data), inverse, np.uint64))
            plain = (rolled[ends - 1] - before) * back[starts] if len(starts) else before
            self.word = ((plain ^ (plain >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64) % WORD_BUCKETS
        self.gram = hashed[inside[: len(hashed)]].astype(np.int64) % GRAM_BUCKETS
        self.counts = sizes - 2
        self.starts = np.cumsum(self.counts) - self.counts

    def __len__(self) -> int:
        return len(self.word)


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, text) of all overlapping windows; the last of a text reaches its end; a text without words has one."""
    sizes = np.diff(at)
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), counts)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return at[doc] + rank * STRIDE, doc


def grid_of(ids: np.ndarray, at: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Word numbers of windows, -1 past the end of a text."""
    place = first[:, None] + np.arange(WINDOW)
    inside = place < at[doc + 1][:, None]
    return np.where(inside, np.append(ids, -1)[np.minimum(place, len(ids))], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes; arrays are float32."""

    def __init__(self, seed: int = 7, parameters: dict[str, np.ndarray] | None = None):
        if parameters is not None:
            self.p = parameters
            return
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h, d = HIDDEN, 2 * WIDTH
        self.p = {
            "words": (0.05 * rng.standard_normal((WORD_BUCKETS, WIDTH))).astype(np.float32),
            "grams": (0.05 * rng.standard_normal((GRAM_BUCKETS, WIDTH))).astype(np.float32),
            "w": scale(d, 6 * h),
            "b": np.zeros(6 * h, np.float32),
            "v": np.zeros(2 * h, np.float32),
            "o": scale(2 * h),
            "c": np.zeros(1, np.float32),
        }
        for side in "fg":
            self.p |= {f"{side}zr": scale(h, 2 * h), f"{side}c": scale(h, h)}

    def forget_rare(self, vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> None:
        """Clears the embeddings of words and trigrams that fewer than ``SEEN`` texts hold."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        held = np.unique(doc * len(vocabulary) + ids) % max(1, len(vocabulary))
        texts = np.bincount(held, minlength=len(vocabulary))
        words = np.bincount(vocabulary.word, texts, WORD_BUCKETS)
        grams = np.bincount(vocabulary.gram, np.repeat(texts, vocabulary.counts), GRAM_BUCKETS)
        self.live = {"words": (words >= SEEN)[:, None].astype(np.float32), "grams": (grams >= SEEN)[:, None].astype(np.float32)}
        for k, live in self.live.items():
            self.p[k] *= live

    def inputs(self, vocabulary: Vocabulary, which: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what the backward pass needs."""
        which = np.arange(len(vocabulary)) if which is None else which
        counts = vocabulary.counts[which]
        begins = np.cumsum(counts) - counts
        place = np.repeat(vocabulary.starts[which] - begins, counts) + np.arange(counts.sum())
        grams = vocabulary.gram[place]
        mean = np.add.reduceat(self.p["grams"][grams], begins, axis=0) / counts[:, None].astype(np.float32) if len(which) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([self.p["words"][vocabulary.word[which]], mean], axis=1), (which, grams, counts)

    def forward(self, projected: np.ndarray, grid: np.ndarray, keep: bool = False):
        """Logits of windows; ``projected`` has the input projection of every word number."""
        p, h, n = self.p, HIDDEN, len(grid)
        projected = np.concatenate([projected, np.zeros((1, 6 * h), np.float32)])
        mask = (grid >= 0).astype(np.float32)
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        saved: dict[str, list] = {"f": [], "g": []}
        for side, order, lo in (("f", range(WINDOW), 0), ("g", range(WINDOW - 1, -1, -1), 3 * h)):
            state = np.zeros((n, h), np.float32)
            own, zr, c = np.ascontiguousarray(projected[:, lo : lo + 3 * h]), p[f"{side}zr"], p[f"{side}c"]
            for t in order:
                x = own[grid[:, t]]
                gates = _sigmoid(x[:, : 2 * h] + state @ zr)
                z, r = gates[:, :h] * mask[:, t, None], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + (r * state) @ c)
                if keep:
                    saved[side].append((t, state, gates, new))
                state = state + z * (new - state)
                states[t, :, lo // 3 : lo // 3 + h] = state
        energy = np.where(mask.T > 0, states @ p["v"], -1e9)
        weight = np.exp(energy - energy.max(0)) * mask.T
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logits = pooled @ p["o"] + p["c"][0]
        return (logits, (mask, states, saved, weight, pooled)) if keep else logits

    def backward(self, error: np.ndarray, grid: np.ndarray, kept: tuple, n_words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the input projections of the words."""
        p, h = self.p, HIDDEN
        mask, states, saved, weight, pooled = kept
        g = {"o": pooled.T @ error, "c": error.sum(keepdims=True)}
        pulled = error[:, None] * p["o"]
        slope = np.einsum("tnk,nk->tn", states, pulled)
        turn = weight * (slope - (weight * slope).sum(0))
        g["v"] = np.einsum("tn,tnk->k", turn, states)
        flow = weight[:, :, None] * pulled + turn[:, :, None] * p["v"]
        into = np.zeros((n_words + 1, 6 * h), np.float32)
        order = np.argsort(grid.ravel(), kind="stable")
        words, starts = np.unique(grid.ravel()[order], return_index=True)
        for side, lo in (("f", 0), ("g", 3 * h)):
            zr, c = p[f"{side}zr"], p[f"{side}c"]
            g[f"{side}zr"], g[f"{side}c"] = np.zeros_like(zr), np.zeros_like(c)
            later, steps = np.zeros((len(error), h), np.float32), np.zeros((len(error), WINDOW, 3 * h), np.float32)
            for t, state, gates, new in reversed(saved[side]):
                d = later + flow[t, :, lo // 3 : lo // 3 + h]
                z0, r, m = gates[:, :h], gates[:, h:], mask[:, t, None]
                dnew = d * z0 * m * (1 - new * new)
                reset = dnew @ c.T
                dgates = np.concatenate([d * (new - state) * m, reset * state], axis=1) * gates * (1 - gates)
                g[f"{side}c"] += (r * state).T @ dnew
                g[f"{side}zr"] += state.T @ dgates
                later = d * (1 - z0 * m) + reset * r + dgates @ zr.T
                steps[:, t, : 2 * h], steps[:, t, 2 * h :] = dgates, dnew
            into[words, lo : lo + 3 * h] = np.add.reduceat(steps.reshape(-1, 3 * h)[order], starts, axis=0)
        return g, into[:n_words]

    def projected(self, vocabulary: Vocabulary) -> np.ndarray:
        return self.inputs(vocabulary)[0] @ self.p["w"] + self.p["b"]


def fit(network: Network, vocabulary: Vocabulary, grid: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 512, seed: int = 3) -> None:
    """Adam on the logistic loss of windows."""
    rng, step = np.random.default_rng(seed), 0
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    for _ in range(max(epochs, -(-STEPS // max(1, len(grid) // batch)))):
        for rows in np.array_split(rng.permutation(len(grid)), max(1, len(grid) // batch)):
            words, local = np.unique(grid[rows], return_inverse=True)
            pad = int(words[0] == -1)
            local = local.reshape(len(rows), WINDOW) - pad
            x, (which, grams, counts) = network.inputs(vocabulary, words[pad:])
            logits, kept = network.forward(x @ network.p["w"] + network.p["b"], local, keep=True)
            error = ((_sigmoid(logits) - y[rows]) / len(rows)).astype(np.float32)
            g, into = network.backward(error, local, kept, len(which))
            g |= {"w": x.T @ into, "b": into.sum(0)}
            back = into @ network.p["w"].T
            g["words"], g["grams"] = np.zeros_like(network.p["words"]), np.zeros_like(network.p["grams"])
            np.add.at(g["words"], vocabulary.word[which], back[:, :WIDTH])
            np.add.at(g["grams"], grams, np.repeat(back[:, WIDTH:] / counts[:, None], counts, axis=0))
            for k, live in network.live.items():
                g[k] *= live
            step += 1
            for k, v in network.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] * g[k] - second[k])
                if k in network.live:
                    v *= 1 - DECAY * rate
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)


class Model:
    """A trained network with the calibration of its largest window score."""

    def __init__(self, network: Network | None, slope: float, shift: float):
        self.network, self.slope, self.shift = network, slope, shift

    def largest(self, column: pa.Array) -> np.ndarray:
        """Largest window logit of every text."""
        words, ids, at = words_of(column, LETTERS)
        projected = self.network.projected(Vocabulary(words.cast(pa.large_binary()).to_pylist()))
        first, doc = windows_of(at)
        out = np.full(len(at) - 1, -np.inf)
        for i in range(0, len(first), 16_384):
            a, b = first[i : i + 16_384], doc[i : i + 16_384]
            np.maximum.at(out, b, self.network.forward(projected, grid_of(ids, at, a, b)))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.shift)
        return _sigmoid(self.slope * self.largest(column) + self.shift)


def _rank(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each entry within its (ascending) group by order."""
    by = np.lexsort((order, group))
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(np.flatnonzero(np.diff(group, prepend=-1)), np.bincount(group)[np.unique(group)])
    return out


def train(texts: list[str | None], toxic: np.ndarray, apart: np.ndarray, epochs: int = 3, seed: int = 5) -> Model:
    """Trains on the texts; those marked ``apart`` only calibrate."""
    if not toxic.any() or toxic.all():
        return Model(None, 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    if len({*toxic[apart].tolist()}) < 2 or len({*toxic[~apart].tolist()}) < 2:
        apart = np.zeros(len(toxic), bool)
    rng, column = np.random.default_rng(seed), pa.array(texts, pa.large_string())
    words, ids, at = words_of(column, LETTERS)
    vocabulary = Vocabulary(words.cast(pa.large_binary()).to_pylist())
    network = Network()
    network.forget_rare(vocabulary, ids, at)
    first, doc = windows_of(at)
    learnt = np.flatnonzero(~apart[doc])
    first, doc = first[learnt], doc[learnt]
    y = toxic[doc].astype(np.float32)
    order = rng.random(len(doc))
    for turn in range(ROUNDS):
        # First windows at random, then those that score most in their document.
        rank = _rank(doc, order)
        chosen = rank < (PER_TEXT if not turn else PER_TEXT // 2)
        if turn:
            chosen &= (y == 0) | (rank == 0) | (order < 0)
            chosen |= (y == 0) & (rng.random(len(doc)) < (y == 0).sum() ** -1.0 * 2000)
        # Windows without a word are clean, and so is any word of a clean text, repeated over a window.
        grid = grid_of(ids, at, first[chosen], doc[chosen])
        clean = grid[y[chosen] == 0]
        blank, echo = np.full((len(grid) // 32 + 1, WINDOW), -1), len(clean) // 8
        word = clean[rng.integers(0, len(clean), echo), rng.integers(0, WINDOW, echo)]
        grid = np.concatenate([grid, blank, np.repeat(word[:, None], WINDOW, axis=1)])
        fit(network, vocabulary, grid, np.concatenate([y[chosen], np.zeros(len(blank) + echo, np.float32)]), epochs if not turn else 2, 0.01 if not turn else 0.005, seed=seed + turn)
        if turn < ROUNDS - 1:
            projected = network.projected(vocabulary)
            order = -np.concatenate([network.forward(projected, grid_of(ids, at, first[i : i + 16_384], doc[i : i + 16_384])) for i in range(0, len(first), 16_384)])
    model = Model(network, 1.0, 0.0)
    held = apart if apart.any() else np.ones(len(toxic), bool)
    slope, shift = _calibrate(model.largest(column.filter(pa.array(held))), toxic[held].astype(float))
    return Model(network, slope, shift)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic regression on one input, lightly shrunk; Newton's method with halved steps where it would climb."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    loss = lambda w: float(np.logaddexp(0, design @ w).sum() - y @ (design @ w) + 0.05 * w @ w)
    w = np.zeros(2)
    for _ in range(60):
        p = _sigmoid(design @ w)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (p - y) + 0.1 * w)
        while loss(w - step) > loss(w) + 1e-12 and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Trains on labelled rows that are not held out: at most ``sample`` toxic ones and ``CLEAN`` times as many others, none with a text of over ``longest`` bytes."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"))
    hashed = F.xxhash64(key, F.lit(11))
    chosen = None
    for value in (0, 1):
        part = hashed_sample(known.where((F.col("_label") == value) & ~held_out), F.col(key), sample * (1 if value else CLEAN))
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(key, text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= longest).join(F.broadcast(chosen), key).orderBy(hashed, key).limit((1 + CLEAN) * sample)
    rows = found.select(text, "_label", (F.pmod(F.xxhash64(key, F.lit(12)), F.lit(4)) == 0).alias("_apart")).collect()
    return train([r[0] for r in rows], np.array([r[1] == 1 for r in rows], bool), np.array([r[2] for r in rows], bool))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    bound_batches(docs.sparkSession)
    plain = (model.network.p if model.network else None, model.slope, model.shift)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters, slope, shift = shared.value
        model = Model(Network(parameters=parameters) if parameters else None, slope, shift)
        for _, table in chunks(batches, text, CHUNK):
            yield from pa.Table.from_arrays([table.column(0).combine_chunks(), pa.array(model.score(table.column(1)), pa.float64())], names=[key, "score"]).to_batches()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
