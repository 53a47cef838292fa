"""The network: gradients, held-out accuracy, odd texts."""

from __future__ import annotations

import numpy as np

from faultline.llm import language

from .conftest import ODD


def test_gradients():
    network = language.ByteNetwork(["a", "b", "c"], hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    random = np.random.default_rng(1)
    windows, labels = random.integers(0, 5, (4, 7)).astype(np.uint8), np.array([0, 2, 1, 1])

    def loss():
        p = network.probabilities(network.states(windows)[0])
        picked = np.log(p[:, np.arange(4), labels]) * (windows != 0).T
        return -picked.sum() / (windows != 0).sum()

    grads = network.gradients(windows, labels)
    for name, weights in network.weights.items():
        flat = weights.reshape(-1)
        for i in np.argsort(-np.abs(grads[name].reshape(-1)))[:6]:
            kept, step = flat[i], 1e-2
            flat[i] = kept + step
            above = loss()
            flat[i] = kept - step
            below = loss()
            flat[i] = kept
            assert abs((above - below) / (2 * step) - grads[name].reshape(-1)[i]) < 2e-3


def test_identification(docs):
    english, german = "the weather is nice and the people are walking there", "das wetter ist schön und die leute gehen dort spazieren"
    table = docs(*[f"{english} {i}" for i in range(30)]).union(docs(*[(100 + i, f"{german} {i}") for i in range(30)], lang="de"))
    network = language.train(table, steps=60)
    test = docs("the people and the weather", "die leute und das wetter", *ODD, "12 34 !?")
    got = {r.doc_id: r for r in language.identify(test, network, keep=("n", "node")).collect()}
    assert (got[0].lang_pred, got[1].lang_pred) == ("en", "de") and got[0].n == "x"
    assert [got[2 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[2 + len(ODD)].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0
    assert language.identify(docs("a"), language.train(docs())).first().lang_pred == "und"
    assert language.identify(docs(), network).count() == 0


def test_a_text_is_pooled_over_all_its_bytes():
    network = language.ByteNetwork(["a", "b"])
    texts = [b"x", b"abc" * 100, b"y" * 128]
    together = network.pooled(texts)
    for text, row in zip(texts, together, strict=True):
        assert np.allclose(network.pooled([text])[0], row, atol=1e-6)
