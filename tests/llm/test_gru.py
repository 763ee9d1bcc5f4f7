"""The recurrent model against plain loops: gradients and likelihood, very long texts."""

import numpy as np
import pytest

from kredo.llm import gru

LAYOUT = gru.Layout(classes=3, size=4, bins=2)


def model(seed=1, hidden=5):
    rng = np.random.default_rng(seed)
    p = gru.initial(LAYOUT, np.arange(1, LAYOUT.inputs + 1, dtype=float), hidden)
    return {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in p.items()}


def texts(seed, n=7, longest=30):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, LAYOUT.inputs, rng.integers(1, longest)) for _ in range(n)]
    for d in docs:
        d[-1] = 0
    return docs


def plain(p, doc):
    """Log-likelihood of one document, token by token."""
    h, last, total, n = np.zeros(p["u"].shape[0]), 0, 0.0, p["u"].shape[0]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    for t in doc:
        a, g = p["in"][last], h @ p["u"]
        r, z = sigmoid(a[:n] + g[:n]), sigmoid(a[n:2 * n] + g[n:2 * n])
        c = np.tanh(a[2 * n:] + r * g[2 * n:])
        h = (1 - z) * c + z * h
        kind = t // LAYOUT.size if t < LAYOUT.head else LAYOUT.classes + t - LAYOUT.head
        total += log_softmax(h @ p["cw"] + p["cb"])[kind]
        if t < LAYOUT.head:
            total += log_softmax(h @ p["ww"][kind] + p["wb"][kind])[t % LAYOUT.size]
        last = t
    return total


def test_score_is_that_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(gru, "SCORE_STEPS", 4)
    p = {k: v.astype(np.float32) for k, v in model().items()}
    docs = texts(2)
    assert gru.score(p, LAYOUT, docs) == pytest.approx([plain(p, d) for d in docs], rel=1e-4)
    assert len(gru.score(p, LAYOUT, [])) == 0


def test_gradients_are_those_of_the_loss():
    """Central differences of the loss of one window, whose loss is the plain loop's."""
    p, docs = model(3), sorted(texts(4, n=4, longest=9), key=len, reverse=True)
    steps = len(docs[0])
    live = [sum(len(d) > t for d in docs) for t in range(steps)]
    target = np.concatenate([[d[t] for d in docs[:n]] for t, n in enumerate(live)])
    token = np.concatenate([[0] * live[0], *[[d[t - 1] for d in docs[:n]] for t, n in enumerate(live) if t]]).astype(int)

    class Exact(gru.Trainer):
        def __init__(self, p):
            self.p, self.layout = p, LAYOUT

    # the window works in single precision
    grad, change, _ = Exact(p).gradients(token, target, live, np.zeros((len(docs), 5)))
    rows = np.zeros_like(p["in"])
    np.add.at(rows, token, change)
    rng, eps = np.random.default_rng(0), 1e-5
    for name, g in {**grad, "in": rows}.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in g.shape)
            loss = []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += sign * eps
                loss.append(-sum(plain(q, d) for d in docs))
            assert g[at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=2e-3, abs=2e-4), (name, at)


def test_training_learns_and_holds_no_padding():
    rng = np.random.default_rng(5)
    turn = np.array([1, 5, 9, 2] * 400)
    docs = [np.append(np.roll(turn, -int(rng.integers(0, 4)))[:int(rng.integers(5, 40))], 0) for _ in range(60)]
    docs.append(np.append(np.tile(turn, 60), 0))                 # one text that is a thousand times as long
    p = gru.initial(LAYOUT, np.bincount(np.concatenate(docs), minlength=LAYOUT.inputs).astype(float))
    before = gru.score(p, LAYOUT, docs).sum()
    trainer = gru.Trainer(p, LAYOUT)
    for _ in range(3):
        trainer.train(docs)
    after = gru.score(trainer.p, LAYOUT, docs).sum()
    assert after > 0.3 * before and all(np.isfinite(v).all() for v in trainer.p.values())


def test_one_thread_can_be_called_anywhere():
    gru.one_thread()
    assert (np.ones((20, 20)) @ np.ones((20, 20)) == 20).all()


def test_lanes_read_each_document_from_a_fresh_state():
    """A window over two documents in one lane is one window over each, apart."""
    p, docs = model(8), [d for d in texts(9, n=2, longest=8)]
    trainer = object.__new__(gru.Trainer)
    trainer.p, trainer.layout = p, LAYOUT
    both = np.concatenate(docs)
    token = np.concatenate([[0], both[:-1]])
    fresh = np.zeros(len(both), bool)
    fresh[[0, len(docs[0])]] = True
    token[fresh] = 0
    grad, change, _ = trainer.gradients(token, both, [1] * len(both), np.ones((1, 5)), fresh)
    apart = [trainer.gradients(np.concatenate([[0], d[:-1]]).astype(int), d, [1] * len(d), np.zeros((1, 5))) for d in docs]
    for k in grad:
        assert grad[k] == pytest.approx(apart[0][0][k] + apart[1][0][k], rel=1e-4, abs=1e-5)
    assert change == pytest.approx(np.concatenate([apart[0][1], apart[1][1]]), rel=1e-4, abs=1e-5)


def test_every_token_is_trained_on_once():
    docs = texts(10, n=150, longest=70)
    p = {k: v.astype(np.float32) for k, v in model(11).items()}
    seen = []

    class Counting(gru.Trainer):
        def _window(self, token, target, live, h, fresh):
            seen.append(target)
            assert len(target) == sum(live) and live == sorted(live, reverse=True) and live[0] <= 16
            return super()._window(token, target, live, h, fresh)

    assert Counting(p, LAYOUT).train(iter(docs), lanes=16) == sum(map(len, docs))
    assert sorted(np.concatenate(seen).tolist()) == sorted(np.concatenate(docs).tolist())
    assert Counting(p, LAYOUT).train(iter([])) == 0


def test_documents_are_scored_alike_in_any_company(monkeypatch):
    p = {k: v.astype(np.float32) for k, v in model(12).items()}
    docs = texts(13, n=40)
    together = gru.score(p, LAYOUT, docs)
    monkeypatch.setattr(gru, "SIDE_BY_SIDE", 7)
    monkeypatch.setattr(gru, "OUTPUTS", 5)
    assert gru.score(p, LAYOUT, docs) == pytest.approx(together, rel=1e-5)
    assert together == pytest.approx([plain(p, d) for d in docs], rel=1e-4)


def test_a_window_moves_what_has_a_gradient_and_nothing_else(monkeypatch):
    """One window of a few classes against Adagrad written out over all parameters."""
    layout = gru.Layout(classes=8, size=4, bins=2)
    p = gru.initial(layout, np.arange(1, layout.inputs + 1, dtype=float), 5)
    trainer = gru.Trainer(p, layout)
    doc = np.array([1, 2, 9, 33, 8, 1, 0])               # head words of classes 0 and 2, and a bin
    token = np.concatenate([[0], doc[:-1]])
    grad, change, _ = trainer.gradients(token, doc, [1] * len(doc), np.zeros((1, 5)))
    grad["in"] = np.zeros_like(p["in"])
    np.add.at(grad["in"], token, change)
    norm = np.sqrt(sum(float((g * g).sum()) for k, g in grad.items() if k != "in"))
    moved = []
    move = gru.Trainer._move
    monkeypatch.setattr(gru.Trainer, "_move", lambda self, k, at, g: (moved.append((k, len(g))), move(self, k, at, g)))
    trainer._window(token, doc, [1] * len(doc), np.zeros((1, 5)), np.zeros(len(doc), bool))
    for k, g in grad.items():
        g = g * min(1.0, gru.CLIP / norm)
        assert trainer.p[k] == pytest.approx(p[k] - gru.RATE * g / np.sqrt(0.1 + g * g), rel=1e-4, abs=1e-6), k
    assert dict(moved)["ww"] == 2 and dict(moved)["wb"] == 2


def test_texts_without_head_words():
    """Windows whose targets are bins alone, with as many classes and words as in use."""
    layout = gru.Layout(classes=8, size=8, bins=8)
    p = gru.initial(layout, np.ones(layout.inputs))
    docs = [np.full(50, layout.head + 3), np.full(7, layout.head)]
    trainer = gru.Trainer(p, layout)
    assert trainer.train(docs) == 57
    assert (trainer.p["ww"] == p["ww"]).all() and (trainer.p["cw"] != p["cw"]).any()
    assert (gru.score(trainer.p, layout, docs) > gru.score(p, layout, docs)).all()


def test_column_sums_have_the_bits_of_row_sums():
    x = np.random.default_rng(6).standard_normal((64, 500)).astype(np.float32)
    assert (gru._sums(x) == x.T.copy().sum(axis=1)).all()
    assert len(gru._sums(x[:, :0])) == 0


def test_row_sums_are_those_of_a_reduction():
    x = np.random.default_rng(7).standard_normal((200, 6)).astype(np.float32)
    begins = np.array([0, 1, 3, 4, 30, 32, 35, 199])
    assert (gru._row_sums(x, begins) == np.add.reduceat(x, begins, axis=0)).all()


def test_windows_take_no_new_memory():
    """What a window frees serves the next one; pages mapped again took an eighth of its time or more."""
    import resource

    gru.keep_memory()
    layout = gru.Layout(classes=32, size=64, bins=32)
    trainer = gru.Trainer(gru.initial(layout, np.ones(layout.inputs)), layout)
    docs = list(np.random.default_rng(8).integers(0, layout.inputs, (gru.LANES, 10 * gru.STEPS)))
    trainer.train(docs)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    trainer.train(docs)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 10 * 100
