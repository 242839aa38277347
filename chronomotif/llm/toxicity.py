"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the embedding of its hash beside the mean embedding of its character trigrams. Texts are cut into
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, the last one padded; every window is scored, and a text's score
is the highest. Training is by the same rule: in each round the highest window of every training text is found, and the
network learns from those windows, so a text's label needs to hold for one window only.

Training uses at most ``max_labelled`` labelled rows, chosen by a hash of the id within each label, on the driver; the
network has a fixed size and is broadcast. Inputs are words and characters alone. Scoring is one pass without a shuffle;
the gate inputs of a word are worked out once a worker while its table lasts (``TABLE`` words), in batches of windows.

Defined cases: null, empty or wordless texts are one padded window, whose score is the bias alone; very long texts are
scored whole, window by window in bounded batches; repeated rows get a score each; an empty table gives no rows; without
labelled rows every score is 0; ids labelled both ways teach nothing; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.llm.common import ship, tidy
from chronomotif.llm.quality_model import agreed, chosen

WINDOW, STRIDE, HIDDEN, WIDTH = 48, 32, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 17, 1 << 13
TABLE = 150_000
BATCH = 4096
_WORD = re.compile(r"[^\W_]+")
_STATE: dict = {}


def forget() -> None:
    """Empties the worker's table of words."""
    _STATE.clear()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_slot(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % WORD_ROWS


def char_slots(word: str) -> list[int]:
    import xxhash

    marked = f"^{word}$"
    return [xxhash.xxh3_64_intdigest(marked[i : i + 3].encode("utf-8", "surrogatepass"), 1) % CHAR_ROWS for i in range(len(marked) - 2)]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Rows of WINDOW places of a text; -1 pads."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1) if len(ids) > WINDOW else 1
    padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
    padded[: len(ids)] = ids
    return padded[np.arange(n)[:, None] * STRIDE + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters as one dict of float32 arrays; gates in the order update, reset, candidate; two directions."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
        self.p = {
            "word": small(WORD_ROWS, WIDTH, s=0.02), "char": small(CHAR_ROWS, WIDTH, s=0.02),
            "w": small(2, 2 * WIDTH, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": small(2, HIDDEN, 3 * HIDDEN),
            "att": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, 2 * WIDTH)"""
        out = np.zeros((len(words), 2 * WIDTH), np.float32)
        if words:
            out[:, :WIDTH] = self.p["word"][[word_slot(w) for w in words]]
            slots = [char_slots(w) for w in words]
            counts = np.array([len(s) for s in slots])
            flat = self.p["char"][np.concatenate(slots).astype(np.int64)]
            out[:, WIDTH:] = np.add.reduceat(flat, np.cumsum(counts) - counts) / counts[:, None]
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 * HIDDEN): input parts of the gates; the last row is for padding."""
        out = np.einsum("nk,dkh->dnh", x, self.p["w"]) + self.p["b"][:, None]
        return np.concatenate([out, np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)

    def forward(self, gates: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows ``rows`` (places in ``gates``; -1 pads), with what backward needs."""
        n, real = len(rows), rows >= 0
        states = np.zeros((2, WINDOW, n, HIDDEN), np.float32)
        tape: list = []
        for d in range(2):
            u = self.p["u"][d]
            uzr, un = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g = gates[d][rows[:, t]]
                zr = sigmoid(g[:, : 2 * HIDDEN] + h @ uzr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ un)
                if keep:
                    tape.append((d, t, h, z, r, c))
                h = np.where(real[:, t, None], h + z * (c - h), h)
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], 2)
        a = np.where(real.T, both @ self.p["att"], -1e9)
        a = np.exp(a - a.max(0)) * real.T
        a = a / np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * both).sum(0)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return (logits, (both, a, pooled, real, tape)) if keep else logits

    def backward(self, kept, rows: np.ndarray, d_logit: np.ndarray, n_gates: int) -> tuple[dict, np.ndarray]:
        """(gradients of the small parameters, of the gate inputs)."""
        both, a, pooled, real, tape = kept
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        grad["bias"][0], grad["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pool = d_logit[:, None] * self.p["out"]
        d_a = (both * d_pool).sum(2)
        d_score = a * (d_a - (a * d_a).sum(0))
        grad["att"] = np.einsum("tn,tnh->h", d_score, both)
        d_both = a[:, :, None] * d_pool + d_score[:, :, None] * self.p["att"]
        d_steps = np.zeros((2, WINDOW, len(rows), 3 * HIDDEN), np.float32)
        d_h, last = None, None
        for d, t, h, z, r, c in reversed(tape):
            if d != last:
                d_h, last = np.zeros_like(h), d
            u = self.p["u"][d]
            d_h = d_h + d_both[t][:, d * HIDDEN : (d + 1) * HIDDEN]
            on = real[:, t, None]
            dn = np.where(on, d_h, 0)
            dc = dn * z * (1 - c * c)
            d_rh = dc @ u[:, 2 * HIDDEN :].T
            dz = dn * (c - h) * z * (1 - z)
            dr = d_rh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            grad["u"][d, :, : 2 * HIDDEN] += h.T @ dzr
            grad["u"][d, :, 2 * HIDDEN :] += (r * h).T @ dc
            d_steps[d, t] = np.concatenate([dzr, dc], 1)
            d_h = np.where(on, dn * (1 - z) + d_rh * r + dzr @ u[:, : 2 * HIDDEN].T, d_h)
        return grad, np.stack([_added(rows.T.reshape(-1) % n_gates, x.reshape(-1, 3 * HIDDEN), n_gates) for x in d_steps])


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    if len(places):
        out[places] = np.add.reduceat(rows[order], starts)
    return out


def fit(texts: list[str | None], labels: list[int], rounds: int = 3, passes: int = 3, rate: float = 0.05, batch: int = 64, least: int = 10, least_steps: int = 200, seed: int = 0) -> Network:
    """Trains on whole texts by AdaGrad; the first word dimension starts at the smoothed log odds of the word's texts.

    A round makes ``least_steps`` steps or more. Words of fewer than ``least`` texts keep a zero word embedding and are known by their characters alone.
    """
    net = Network(seed)
    if not texts:
        net.p["bias"][0] = -100.0
        return net
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows = [windows_of(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64)) for t in texts]
    y = np.array(labels, np.float32)
    words = list(vocabulary)
    slot = np.array([word_slot(w) for w in words], np.int64)
    chars = [np.array(char_slots(w), np.int64) for w in words]
    seen = np.zeros((2, WORD_ROWS), np.float32)
    for r, label in zip(rows, labels, strict=True):
        seen[label, np.unique(slot[np.unique(r[r >= 0])])] += 1
    odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5) * ((y == 0).sum() + 1) / ((y == 1).sum() + 1))
    common = seen.sum(0) >= least  # words of fewer texts would only be learned by heart
    net.p["word"][~common] = 0
    clear = np.abs(odds) >= 3 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    net.p["word"][common & clear, 0] = np.clip(odds, -4, 4)[common & clear] * 0.5
    net.p["bias"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    square = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}

    def step(key: str, grad: np.ndarray, at=slice(None)) -> None:
        square[key][at] += grad * grad
        net.p[key][at] -= rate * (0.2 if key in ("word", "char") else 1) * grad / np.sqrt(square[key][at])

    for k in range(rounds):
        if k == 0:  # no network yet: the window with the clearest word
            logits = np.append(net.p["word"][slot, 0], -9.0)[flat].max(1)
        else:
            gates = net.gates(net.inputs(words))
            logits = np.concatenate([net.forward(gates, flat[i : i + BATCH]) for i in range(0, len(flat), BATCH)])
        order = np.lexsort((-logits, owner))
        best = flat[order[np.searchsorted(owner[order], np.arange(len(rows)))]]
        spare = flat[[rng.integers(a, b) for a, b in zip(np.searchsorted(owner, np.arange(len(rows))), np.searchsorted(owner, np.arange(len(rows)), "right"), strict=True)]]
        some = y == 0
        data = np.concatenate([best, spare[some]])
        target = np.concatenate([y, y[some]])
        for _ in range(max(passes, -(-least_steps * batch // len(data)))):
            for part in np.array_split(rng.permutation(len(data)), -(-len(data) // batch)):
                used, places = np.unique(data[part], return_inverse=True)
                places = places.reshape(data[part].shape)
                if used[0] == -1:
                    used, places = used[1:], places - 1
                x = net.inputs([words[i] for i in used])
                out, kept = net.forward(net.gates(x), places, keep=True)
                grad, d_gates = net.backward(kept, places, (sigmoid(out) - target[part]) / len(part) * 8, len(used) + 1)
                d_gates = d_gates[:, :-1]
                grad["w"] = np.einsum("nk,dnh->dkh", x, d_gates)
                grad["b"] = d_gates.sum(1)
                dx = np.einsum("dnh,dkh->nk", d_gates, net.p["w"])
                for key, g in grad.items():
                    step(key, g)
                rows_at, where = np.unique(slot[used], return_inverse=True)
                often = common[rows_at]
                step("word", _added(where, dx[:, :WIDTH], len(rows_at))[often], rows_at[often])
                counts = np.array([len(chars[i]) for i in used])
                cat = np.concatenate([chars[i] for i in used]) if len(used) else np.empty(0, np.int64)
                rows_at, where = np.unique(cat, return_inverse=True)
                step("char", _added(where, np.repeat(dx[:, WIDTH:] / np.maximum(counts, 1)[:, None], counts, axis=0), len(rows_at)), rows_at)
        rate *= 0.8
    return net


def score_texts(net: Network, texts: list[str | None], state: dict) -> np.ndarray:
    """The highest window's probability of each text. ``state`` holds the words' gate inputs between calls."""
    lists = [words_of(t) for t in texts]
    known = state.setdefault("known", {})
    missing = list(set().union(*lists) - known.keys())
    if len(known) + len(missing) > TABLE and known:
        known.clear()
        state.pop("gates", None)
        missing = list(set().union(*lists))
    if missing or "gates" not in state:
        for w in missing:
            known[w] = len(known)
        new = net.gates(net.inputs(missing))
        state["gates"] = new if "gates" not in state else np.concatenate([state["gates"][:, :-1], new], 1)
    get = known.__getitem__
    rows = [windows_of(np.fromiter(map(get, w), np.int64, len(w))) for w in lists]
    flat = np.concatenate(rows)
    logits = np.concatenate([net.forward(state["gates"], flat[i : i + BATCH]) for i in range(0, len(flat), BATCH)])
    counts = np.array([len(r) for r in rows])
    return sigmoid(np.maximum.reduceat(logits.astype(np.float64), np.cumsum(counts) - counts))


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text: str, label: str, keep) -> tuple[list, list]:
    """At most ``max_labelled`` labelled texts, a quarter of label 1 where there are as many, by a hash of the id."""
    ids: dict = {}
    known = agreed(labels.where(keep), label, id_col)
    for value, share in ((1, max_labelled // 4), (0, max_labelled - max_labelled // 4)):
        some = known.where(F.col(label) == value).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(share)
        ids |= {r[0]: value for r in some.collect()}
    found = chosen(docs.select(id_col, text), list(ids), id_col).collect()
    found.sort(key=lambda r: (str(r[0]), r[1] or ""))
    return [r[1] for r in found], [ids[r[0]] for r in found]


def toxicity(docs: DataFrame, labels: DataFrame, keep, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 3000, step: int = 300) -> DataFrame:
    """(id, score, predicted) of every document; learns from labelled rows for which ``keep`` holds."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(*labelled_texts(docs, labels, max_labelled, id_col, text, label, keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if _STATE.get("net") is not net:
            _STATE.clear()
            _STATE["net"] = net
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                p = score_texts(net, piece.column(1).to_pylist(), _STATE)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(tidy(run, forget), f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)
