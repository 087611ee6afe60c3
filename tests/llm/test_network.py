"""The network of the toxicity operator against plain loops, and its gradients against finite differences."""

import math
import tracemalloc

import numpy as np

import gleanery.llm.toxicity as t


def sample(seed=0, windows=(5, 32, 1, 17)):
    rng = np.random.default_rng(seed)
    network = t.Network(seed)
    for table in network.tables:
        table *= 10
    size = np.array(windows)
    chars = rng.integers(1, 7, size.sum())
    features = t.Tokens(rng.integers(0, t.TABLES[0], size.sum()).astype(np.int32), rng.integers(0, t.TABLES[1], chars.sum()).astype(np.int32), np.concatenate(([0], np.cumsum(chars))))
    return rng, network, features, np.cumsum(size) - size, size


def plain_logit(network, features):
    """One window, word by word, in double precision."""
    words = []
    for k in features.index:
        grams = features.gram[features.first[k] : features.first[k + 1]]
        words.append(np.concatenate((network.tables[0][features.word[k]], sum(network.tables[1][g].astype(float) for g in grams) / math.sqrt(len(grams)))))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    states = [None, None]
    for way in (0, 1):
        h, out = [0.0] * t.HIDDEN, []
        wx, bx, u = (network.p[k][way].astype(float) for k in ("wx", "bx", "u"))
        for x in words if way == 0 else words[::-1]:
            gate = [sum(x[i] * wx[i, j] for i in range(len(x))) + bx[0, j] for j in range(3 * t.HIDDEN)]
            held = [sum(h[i] * u[i, j] for i in range(t.HIDDEN)) for j in range(3 * t.HIDDEN)]
            new = []
            for j in range(t.HIDDEN):
                z, r = sigmoid(gate[j] + held[j]), sigmoid(gate[t.HIDDEN + j] + held[t.HIDDEN + j])
                n = math.tanh(gate[2 * t.HIDDEN + j] + r * held[2 * t.HIDDEN + j])
                new.append((1 - z) * n + z * h[j])
            h = new
            out.append(h)
        states[way] = out if way == 0 else out[::-1]
    both = [np.array(a + b) for a, b in zip(*states, strict=True)]
    weight = np.array([math.exp(s @ network.p["v"]) for s in both])
    pooled = sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True))
    return float(pooled @ network.p["w"] + network.p["b"][0])


def test_forward_against_plain_loops():
    for seed in range(3):
        _, network, features, start, size = sample(seed)
        got = network.logits(features, start, size)
        want = [plain_logit(network, features.at(np.arange(a, a + n))) for a, n in zip(start, size, strict=True)]
        assert np.allclose(got, want, atol=1e-4)


def test_gradients_against_finite_differences(monkeypatch):
    monkeypatch.setattr(t, "DROPPED", 0.0)
    rng, network, features, start, size = sample(5)
    label, weight = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 0.5, 1], np.float32)

    def loss():
        logit = np.array([plain_logit(network, features.at(np.arange(a, a + n))) for a, n in zip(start, size, strict=True)])
        return float((weight * (np.log1p(np.exp(logit)) - label * logit)).mean())

    grad, used, d_input = network.gradients(features, start, size, label, weight, rng)
    assert len(used) == size.sum() and (used.gram == features.gram).all()

    def slope(array, place, step=1e-2):
        old = array[place]
        array[place] = old + step
        up = loss()
        array[place] = old - step
        down = loss()
        array[place] = old
        return (up - down) / (2 * step)

    for name, g in grad.items():
        places = [np.unravel_index(k, g.shape) for k in rng.choice(g.size, min(g.size, 6), replace=False)]
        for place in places:
            assert math.isclose(slope(network.p[name], place), float(g[place]), rel_tol=0.02, abs_tol=2e-4), (name, place)
    owner = np.repeat(np.arange(len(features)), np.diff(features.first))
    for token in (0, 7, len(features) - 1):
        row = features.word[token]
        assert math.isclose(slope(network.tables[0], (row, 3)), float(d_input[features.word == row, 3].sum()), rel_tol=0.02, abs_tol=2e-4)
        row = features.gram[features.first[token]]
        assert math.isclose(slope(network.tables[1], (row, 3)), float(d_input[owner[features.gram == row], t.WIDTH + 3].sum()), rel_tol=0.02, abs_tol=2e-4)


def test_every_character_of_a_word_counts():
    tokens, counts = t.tokenize(["id10t ab", "id20t ab"])
    assert counts.tolist() == [2, 2] and tokens.runs()[tokens.index].tolist() == [15, 6, 15, 6]
    a, b = (set(tokens.gram[tokens.first[v] : tokens.first[v + 1]].tolist()) for v in tokens.index[[0, 2]])
    assert len(a - b) >= 6 and len(a & b) >= 4 and len(tokens.word) == 3 and tokens.index[1] == tokens.index[3] != tokens.index[0] != tokens.index[2]


def test_windows_of_one_text_are_independent_of_its_neighbours():
    texts = ["you are an utter fool", "", None, "a b c " * 50, "fool"]
    network = sample(9)[1]
    alone = [float(network.scores([x])[0]) for x in texts]
    assert np.allclose(network.scores(texts), alone, atol=1e-6)


def test_training_gathers_some_words_at_a_time():
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, (400, 500, 8), dtype=np.uint8)
    texts = [" ".join(bytes(word).decode() for word in text) for text in letters]
    labels = np.arange(400) % 4 == 0
    tracemalloc.start()
    network = t.train(texts, labels, rounds=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert network.scale.shape == (2,) and peak < 150e6  # 200,000 words of 24 runs of characters: 154 MB of embeddings


def test_blocks_change_no_bit_of_a_network(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "fool", "id10t", "meadow", "über", "x" * 70], n)) for n in [0, 1, 40, 3, 0, 90, 12, 7, 0]]
    labels = np.arange(9) % 3 == 2
    whole, counts = t.tokenize(texts)
    want = t.train(list(texts), labels, rounds=1)
    for size in (1, 50):
        monkeypatch.setattr(t, "GATHERED", size)
        monkeypatch.setattr(t, "COUNTED", size)
        got = t.train(list(texts), labels, rounds=1)
        assert all((a == b).all() for a, b in zip(got.tables, want.tables, strict=True)) and (got.scale == want.scale).all()
        assert all((got.p[k] == want.p[k]).all() for k in want.p)
    (seen, toxic), (seen_runs, toxic_runs) = t._met(whole, counts, labels.astype(np.float32))
    begin = np.cumsum(counts) - counts
    own = [whole.at(np.arange(a, a + n)) for a, n in zip(begin, counts, strict=True)]
    for table, (all_of, ones) in (("word", (seen, toxic)), ("gram", (seen_runs, toxic_runs))):
        sets = [set(getattr(x, table).tolist()) for x in own]
        rows = set().union(*sets)
        assert {int(r) for r in np.flatnonzero(all_of)} == rows and all(all_of[r] == sum(r in x for x in sets) for r in rows)
        assert all(ones[r] == sum(r in x for x, label in zip(sets, labels, strict=True) if label) for r in rows)
