"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes forwards and backwards and labels every byte;
the mean of the label probabilities over a whole text gives its language.  It is trained by
backpropagation through time, in numpy, on excerpts of a bounded sample of labelled documents,
and applied to all windows of all texts, many windows side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, columns_of, reachable

#: Bytes in a window; byte 0 fills the last one of a text and counts for nothing.
SPAN = 128
#: Windows computed side by side.
LANES = 2048
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


class ByteNetwork:
    """Two gated recurrent layers, one per direction, and one label layer over both."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 5):
        random, n = np.random.default_rng(seed), len(labels)
        self.labels, self.hidden = labels, hidden
        self.weights = {
            "bytes": random.normal(0, 0.3, (2, 256, 3 * hidden)), "inner": random.normal(0, 0.3, (2, hidden, 3 * hidden)),
            "out": random.normal(0, 0.3, (2 * hidden, n)), "bias": np.zeros(n)}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def states(self, windows: np.ndarray, keep: bool = False):
        """The states after each byte (time, direction, window, unit), and what training needs again."""
        h, inner = self.hidden, self.weights["inner"]
        both = np.stack((windows, windows[:, ::-1]))
        shift = np.array([0, 256])[:, None]
        table = self.weights["bytes"].reshape(512, 3 * h)
        state = np.zeros((2, len(windows), h), np.float32)
        out = np.empty((windows.shape[1], 2, len(windows), h), np.float32)
        kept = []
        for t in range(windows.shape[1]):
            index = both[:, :, t] + shift
            read, own = table[index], state @ inner
            # A logistic gate is half a hyperbolic tangent and a half.
            gates = np.tanh((read[..., :2 * h] + own[..., :2 * h]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            update, reset = gates[..., :h], gates[..., h:]
            new = np.tanh(read[..., 2 * h:] + reset * own[..., 2 * h:])
            if keep:
                kept.append((index, state, own, update, reset, new))
            state = new + update * (state - new)
            out[t] = state
        return out, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Label probabilities of each byte (time, window, label)."""
        h, out = self.hidden, self.weights["out"]
        logits = states[:, 0] @ out[:h] + states[::-1, 1] @ out[h:] + self.weights["bias"]
        np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all bytes that are not filling."""
        h, w = self.hidden, self.weights
        states, kept = self.states(windows, keep=True)
        counts = (windows != 0).T[..., None]
        error = self.probabilities(states)
        error[:, np.arange(len(labels)), labels] -= 1
        error *= counts / max(1, counts.sum())
        ahead, back = states[:, 0], states[::-1, 1]
        grads = {"out": np.concatenate((np.einsum("tnh,tnc->hc", ahead, error), np.einsum("tnh,tnc->hc", back, error))),
                 "bias": error.sum(axis=(0, 1)), "inner": np.zeros_like(w["inner"]), "bytes": np.zeros((512, 3 * h), np.float32)}
        from_out = np.stack((error @ w["out"][:h].T, (error @ w["out"][h:].T)[::-1]), axis=1)
        later = np.zeros_like(states[0])
        for t in range(windows.shape[1] - 1, -1, -1):
            index, before, own, update, reset, new = kept[t]
            d = later + from_out[t]
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * own[..., 2 * h:] * reset * (1 - reset)
            d_read = np.concatenate((d_update, d_reset, d_new), axis=-1)
            d_own = np.concatenate((d_update, d_reset, d_new * reset), axis=-1)
            grads["inner"] += before.transpose(0, 2, 1) @ d_own
            np.add.at(grads["bytes"], index.ravel(), d_read.reshape(-1, 3 * h))
            later = d * update + d_own @ w["inner"].transpose(0, 2, 1)
        grads["bytes"] = grads["bytes"].reshape(2, 256, 3 * h)
        return grads

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 160, batch: int = 128, rate: float = 0.02, seed: int = 9) -> None:
        """Adam over random batches with as many windows of each label."""
        random = np.random.default_rng(seed)
        places = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        mean, square = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([random.choice(p, -(-batch // len(places))) for p in places])
            grads = self.gradients(windows[pick], labels[pick])
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g / max(1.0, size)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g**2 - square[k])
                self.weights[k] -= (slow * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text (none empty)."""
        lanes = [-(-len(t) // SPAN) for t in texts]
        first = np.concatenate(([0], np.cumsum(lanes)))
        windows = np.frombuffer(b"".join(t.ljust(n * SPAN, b"\0") for t, n in zip(texts, lanes, strict=True)), np.uint8).reshape(-1, SPAN)
        sums = np.empty((len(windows), len(self.labels)))
        for at in range(0, len(windows), LANES):
            part = windows[at:at + LANES]
            probs = self.probabilities(self.states(part)[0])
            sums[at:at + LANES] = np.einsum("tnc,tn->nc", probs, (part != 0).T.astype(np.float32))
        totals = np.add.reduceat(sums, first[:-1])
        return totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-9)


def windows_of(text: str) -> np.ndarray:
    raw = text.encode()
    return np.frombuffer(raw.ljust(-(-len(raw) // SPAN) * SPAN, b"\0"), np.uint8).reshape(-1, SPAN)


def train(labelled: DataFrame, per_language: int = 300, excerpt: int = 1024, **settings) -> ByteNetwork | None:
    """A network trained on excerpts of at most ``per_language`` documents of each language.

    ``labelled`` has doc_id, text and lang.  Documents are chosen by a hash of their id and text, equal
    ones once, and an excerpt of ``excerpt`` characters by the same hash.  The hash is first held against the
    rows of the language, so about four times as many as are wanted are sorted, however many there are.
    None if nothing is labelled.
    """
    key = F.xxhash64("doc_id", "text")
    start = F.pmod(key, F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1
    order = Window.partitionBy("lang").orderBy("_key", "_text")
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    # One number per label of the network.
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return None
    of_lang = F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])[F.col("lang")]
    sample = (
        usable.filter(F.pmod(key, of_lang) < 4 * per_language).select("lang", key.alias("_key"), F.col("text").substr(start.cast("int"), F.lit(excerpt)).alias("_text"))
        .dropDuplicates(["lang", "_key"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
        .orderBy("lang", "_key", "_text").collect())
    labels = sorted({r["lang"] for r in sample})
    windows = [windows_of(r["_text"]) for r in sample]
    target = np.repeat([labels.index(r["lang"]) for r in sample], [len(w) for w in windows])
    network = ByteNetwork(labels)
    network.train(np.concatenate(windows), target, **settings)
    return network


def identify(docs: DataFrame, network: ByteNetwork | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language) of every whole text.

    A null or empty text, or one without a letter, gets ``und`` and 0; so does every text if
    nothing was labelled.  Equal texts get equal results.  ``keep`` names columns to carry along.
    """
    schema = ", ".join([PREDICTED, *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep and f.name != "doc_id")])
    carried = [n for n in docs.columns if n in keep and n != "doc_id"]

    def label(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (texts,) = columns_of(batch, "text")
        known = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            means = network.pooled([texts[i].encode() for i in known])
            for i, best, score in zip(known, means.argmax(axis=1), means.max(axis=1), strict=True):
                langs[i], scores[i] = network.labels[best], min(1.0, float(score))
        same = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", *carried)]
        yield pa.RecordBatch.from_arrays([same[0], pa.array(langs), pa.array(scores), *same[1:]], ["doc_id", "lang_pred", "score", *carried])

    reachable(docs.sparkSession)
    return arrow_map(docs.select("doc_id", *dict.fromkeys(("text", *carried))), label, schema)


def held_out():
    """Documents that training must not see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
