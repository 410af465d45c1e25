"""The language classifier's training against a plain loop over coordinates."""

import math
import random

import numpy as np

from quillgraph.llm import language_id

ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 5


def plain_fit(samples, idf, languages):
    bias, z, n = 1 << language_id.BITS, {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= L1:
            return 0.0
        return -(z[k] - math.copysign(L1, z[k])) / ((BETA + math.sqrt(n[k])) / ALPHA + L2)

    def scaled(at, counts):
        x = {int(a): math.log1p(c) * idf[a] for a, c in zip(at, counts, strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {**{a: v / norm for a, v in x.items()}, bias: 1.0}

    train = [(y, scaled(at, c)) for k, (y, at, c) in enumerate(samples) if k % 5]
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        for k in order.permutation(len(train)):
            label, x = train[k]
            w = {(m, a): weight((m, a)) for m in range(languages) for a in x}
            scores = [sum(w[m, a] * v for a, v in x.items()) for m in range(languages)]
            e = [math.exp(s - max(scores)) for s in scores]
            for m in range(languages):
                error = e[m] / sum(e) - (m == label)
                for a, v in x.items():
                    g, before = error * v, n.get((m, a), 0.0)
                    z[m, a] = z.get((m, a), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / ALPHA * w[m, a]
                    n[m, a] = before + g * g
    return {k: weight(k) for k in z}, scaled


def test_training_equals_a_plain_loop():
    rnd = random.Random(11)
    idf = np.ones(1 << language_id.BITS)
    idf[:40] = [rnd.uniform(0.5, 3) for _ in range(40)]
    samples = []
    for _ in range(60):
        y = rnd.randrange(3)
        at = np.array(sorted(rnd.sample(range(10 * y, 10 * y + 20), 6)))
        samples.append((y, at, np.array([rnd.randint(1, 4) for _ in at])))
    model = language_id.fit(language_id.Model(["a", "b", "c"], idf, np.zeros((3, (1 << language_id.BITS) + 1))), samples)
    want, scaled = plain_fit(samples, idf, 3)
    assert all(abs(model.weights[m, a] - w) < 1e-9 for (m, a), w in want.items())
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in want.values()) < len(want)  # L1 leaves some at 0

    def loss(t):
        total = 0.0
        for y, at, c in samples[::5]:
            x = scaled(at, c)
            s = [sum(want.get((m, a), 0.0) * v for a, v in x.items()) / t for m in range(3)]
            total -= s[y] - max(s) - math.log(sum(math.exp(v - max(s)) for v in s))
        return total

    grid = [math.exp(k / 100) for k in range(-299, 300)]
    assert loss(model.temperature) <= min(map(loss, grid)) + 1e-6


def test_ties_take_the_first_language():
    model = language_id.Model(["a", "b"], np.ones(1 << language_id.BITS), np.zeros((2, (1 << language_id.BITS) + 1)))
    assert model.predict("text") == ("a", 0.5) and model.predict("") == (language_id.UNKNOWN, 0.0) == model.predict(None) == model.predict("12 !")
