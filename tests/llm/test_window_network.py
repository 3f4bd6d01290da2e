"""The window network of op6: its classes, the order of its training windows, its contexts and its cost."""

import numpy as np

from themeloom.llm import pseudo_lm


def zipf(n: int) -> np.ndarray:
    shares = 1 / np.arange(1, n + 1)
    return shares / shares.sum()


def test_a_place_has_few_outputs():
    shares = zipf(40_000)
    sizes = pseudo_lm.class_sizes(shares)
    assert sizes.sum() == len(shares) and sizes.min() > 0
    outputs = len(sizes) + (np.repeat(sizes, sizes) * shares).sum()
    assert outputs < 2.2 * np.sqrt(shares).sum() < 0.6 * 500  # 100 classes of 400 tokens, as before, have 500


def test_classes_of_any_sizes_make_a_distribution():
    sizes = np.array([1, 4, 2])
    net = pseudo_lm.WindowNetwork(width=3, reach=1, sizes=sizes)
    net.flat[:] = np.random.default_rng(3).normal(0, 0.7, len(net.flat))
    context = np.array([[7, 0], [5, 2], [6, 6]])
    logs = np.stack([net.log_probabilities(context, np.full(3, t)) for t in range(7)], axis=1)
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)
    h = np.tanh(net.near[0][context[:, 0]] + net.near[1][context[:, 1]] + net.bias)
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    for row in range(3):
        by_class = soft(net.class_w[:, :-1] @ h[row] + net.class_w[:, -1])
        plain = np.concatenate([
            by_class[c] * soft(net.token_w[a:b, :-1] @ h[row] + net.token_w[a:b, -1]) for c, (a, b) in enumerate([(0, 1), (1, 5), (5, 7)])
        ])
        assert np.allclose(np.exp(logs[row]), plain, atol=1e-5)


def test_every_gradient_is_the_slope():
    sizes, rng = np.array([1, 3, 2]), np.random.default_rng(4)
    start = pseudo_lm.WindowNetwork(width=3, reach=1, sizes=sizes)
    flat = rng.normal(0, 0.5, len(start.flat))
    make = lambda values: pseudo_lm.WindowNetwork(values, width=3, reach=1, sizes=sizes)
    context, target = np.array([[0, 1], [0, 6], [4, 1], [0, 1]]), np.array([2, 0, 3, 2])
    trainer, found = pseudo_lm.Trainer(make(flat.copy())), make(np.zeros_like(flat))
    trainer._step = lambda name, where, g: getattr(found, name).__setitem__(where, g)
    trainer.learn(context, target)
    mean = lambda values: -make(values).log_probabilities(context, target).mean()
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((mean(up) - mean(down)) / 2e-5 - found.flat[k]) < 1e-7


def test_a_step_is_adagrad():
    net = pseudo_lm.WindowNetwork(classes=2, per_class=3, width=2, reach=1)
    before, trainer = net.flat.copy(), pseudo_lm.Trainer(net, 0.5)
    g = np.float32([[1, -2], [0, 3]])
    for times in (1, 2):
        values = net.near_rows[[5, 1]]
        trainer._step("near_rows", np.array([5, 1]), g)
        assert np.allclose(net.near_rows[[5, 1]], values - 0.5 * g / np.sqrt(pseudo_lm.START_SQUARES + times * g * g))
    rows = slice(2, 4)
    values, g = net.token_w[rows].copy(), np.float32([[1, 2, 3], [0, 0, 4]])
    trainer._step("token_w", rows, g)
    assert np.allclose(net.token_w[rows], values - 0.5 * g / np.sqrt(pseudo_lm.START_SQUARES + g * g))
    assert (net.flat != before).sum() == 3 + 4


def test_windows_come_in_bunches_and_each_once():
    shares, rng = zipf(60_000), np.random.default_rng(6)
    net = pseudo_lm.WindowNetwork(width=2, reach=1, sizes=pseudo_lm.class_sizes(shares))
    tokens = rng.choice(60_000, 60_000, p=shares)
    at = net.in_bunches(tokens, rng)
    assert np.array_equal(np.sort(at), np.arange(len(tokens)))
    kinds = net.kind[tokens[at]]
    steps = [len(set(kinds[k: k + pseudo_lm.WINDOWS_AT_ONCE])) for k in range(0, len(at), pseudo_lm.WINDOWS_AT_ONCE)]
    assert np.mean(steps) < 0.3 * net.classes  # nearly all of them in plain random order
    head = np.flatnonzero(kinds == 0)
    assert head.min() < 0.2 * len(at) and head.max() > 0.8 * len(at)  # a class is spread over the steps
    assert net.in_bunches(tokens[:0], rng).tolist() == []
    few = pseudo_lm.WindowNetwork(width=2, reach=1, classes=1, per_class=60_000)
    assert np.array_equal(np.sort(few.in_bunches(tokens, rng)), np.arange(len(tokens)))


def test_contexts_end_with_their_document():
    net = pseudo_lm.WindowNetwork(classes=5, per_class=2, width=2, reach=2)
    texts = [[1, 2, 3], [], [4], [5, 6]]
    starts = np.cumsum([0, *map(len, texts)])
    got = net.contexts(np.array(sum(texts, [])), starts).tolist()
    none, want = net.tokens, []
    for text in texts:
        padded = [none, none, *text, none, none]
        want += [[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]] for i in range(len(text))]
    assert got == want
    assert net.contexts(np.zeros(0, np.int64), np.zeros(1, np.int64)).shape == (0, 4)


def test_start_is_the_same_everywhere():
    words = pseudo_lm.Vocabulary(np.arange(20, dtype=np.uint64), np.arange(40, 20, -1), np.full(7, 3.0))
    assert np.array_equal(words.start().flat, words.start().flat)
    assert np.allclose(np.exp(words.start().token_w[:, -1]).sum(), 1) and words.sizes.sum() == 27
