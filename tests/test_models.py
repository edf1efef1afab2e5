import numpy as np
import pytest

from quern.models.autograd import Graph, Tensor, erf
from quern.models.encoders import Bert, BertConfig, Gemma, GemmaConfig
from quern.models.lora import Runtime, new_adapter
from quern.models.quantised import Float32, Int4, Int8, attention
from quern.models.training import Options, Pair, Trainer, cosent, infonce, learning_rate, regression, spearman

BERT = Bert.random(BertConfig(24, 12, 2, 3, 16, 16), 3, 0.3)
GEMMA = Gemma.random(GemmaConfig(20, 8, 2, 2, 1, 4, 16, 16), 3, 0.3)


@pytest.mark.parametrize(("model", "ids"), [(BERT, [1, 5, 3, 9, 2]), (GEMMA, [1, 5, 3, 2])])
def test_adapter_gradients_match_differences(model, ids):
    a = new_adapter(model, 3, 6, "all", True, 1)
    rng = np.random.default_rng(0)
    a.weights = {k: (x, rng.normal(0, 0.3, y.shape)) for k, (x, y) in a.weights.items()}
    run = Runtime(a)
    goal = rng.normal(size=model.dim)
    value = lambda: float(model.forward(Graph(), ids, run).data[0] @ goal)
    g = Graph()
    g.backward(model.forward(g, ids, run), goal[None, :])
    for t in run.tensors():
        for i in rng.choice(t.data.size, min(4, t.data.size), replace=False):
            at = np.unravel_index(i, t.data.shape)
            old = t.data[at]
            t.data[at] = old + 1e-5
            up = value()
            t.data[at] = old - 1e-5
            down = value()
            t.data[at] = old
            assert abs((up - down) / 2e-5 - t.grad[at]) < 1e-4 * max(1, abs(t.grad[at]))


def test_every_operation_has_a_right_gradient():
    rng = np.random.default_rng(2)
    x, y, row = Tensor(rng.normal(size=(3, 4)), True), Tensor(rng.normal(size=(3, 4)), True), Tensor(rng.normal(size=(1, 4)), True)
    cos, sin = np.cos(rng.normal(size=(3, 2))), np.sin(rng.normal(size=(3, 2)))
    goal = rng.normal(size=(3, 4))
    ops = [
        lambda g: g.mul(x, y), lambda g: g.add(x, y), lambda g: g.add_row(x, row), lambda g: g.scale(x, 3), lambda g: g.gelu(x), lambda g: g.gelu_tanh(x),
        lambda g: g.layer_norm(x, row, row), lambda g: g.rms_norm(x, row), lambda g: g.softmax(x), lambda g: g.rope(x, cos, sin), lambda g: g.l2_normalise(x),
        lambda g: g.concat_cols([g.slice_cols(x, 0, 1), g.slice_cols(y, 1, 4)]), lambda g: g.matmul(g.matmul(x, y, True), y), lambda g: g.add(x, g.scale(g.concat_cols([x]), 2)),
        lambda g: g.matmul(g.softmax(g.matmul(x, x, True), causal=True), y), lambda g: g.add_row(x, g.mean_rows(y)), lambda g: g.add_row(x, g.row(y, 1)),
    ]
    for op in ops:
        for t in (x, y, row):
            t.grad[:] = 0
        g = Graph()
        out = op(g)
        g.backward(out, goal[: len(out.data)])
        for t in (x, y, row):
            for i in range(t.data.size):
                at = np.unravel_index(i, t.data.shape)
                old = t.data[at]
                vals = []
                for d in (1e-6, -1e-6):
                    t.data[at] = old + d
                    vals.append((op(Graph()).data * goal).sum())
                t.data[at] = old
                assert abs((vals[0] - vals[1]) / 2e-6 - t.grad[at]) < 2e-5


def test_erf_and_frozen_inputs():
    import math

    x = np.linspace(-3, 3, 61)
    assert np.abs(erf(x) - [math.erf(v) for v in x]).max() < 2e-7
    g = Graph()
    g.add(Tensor([[1.0]]), Tensor([[2.0]]))
    assert not g.tape


def test_quantised_products_and_attention():
    rng = np.random.default_rng(4)
    w, x = rng.uniform(-1, 1, (64, 256)), rng.uniform(-1, 1, (3, 256))
    exact = Float32(w).product(x)
    err = lambda y: np.sqrt(((y - exact) ** 2).sum() / (exact**2).sum())
    assert err(Int8(w).product(x)) < 0.03
    assert err(Int4(w).product(x)) < 0.12
    q, k, v = (rng.normal(size=(70, 8)) for _ in range(3))
    z = np.where(np.tril(np.ones((70, 70), bool)), q @ k.T * 0.3, -np.inf)
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(attention(q, k, v, 0.3, True, 16), p / p.sum(1, keepdims=True) @ v)
    assert np.array_equal(Float32(np.array([[1, 2, 0], [0, 1, 1.0]])).product(np.array([[1, 0, 0], [1, 5, 6.0]])), [[1, 0], [11, 11]])


@pytest.mark.parametrize("precision", ["fp32", "int8", "int4"])
def test_inference_equals_the_graph(precision):
    m = Gemma.random(GemmaConfig(40, 64, 2, 4, 1, 32, 128, 64), 5, 0.2)
    ids = list(range(1, 30))
    assert m.inference(ids, precision) @ m.embed(ids) > {"fp32": 0.9999, "int8": 0.995, "int4": 0.9}[precision]
    assert not m.embed([]).any()


def test_loss_gradients():
    rng = np.random.default_rng(6)
    a, p, e = rng.normal(size=(4, 5)), rng.normal(size=(4, 5)), rng.normal(size=(3, 5))
    allow = np.ones((4, 4), bool)
    allow[0, 1] = False
    extra = [[0], [], [1, 2], []]
    f = lambda: infonce(a, p, 0.5, allow, extra, e)
    _, da, dp, de, dt = f()
    assert abs((infonce(a, p, 0.5 + 1e-6, allow, extra, e)[0] - infonce(a, p, 0.5 - 1e-6, allow, extra, e)[0]) / 2e-6 - dt) < 1e-4
    y = np.array([0.1, 0.9, 0.5, 0.5])
    cases = [(f, [(a, da), (p, dp), (e, de)])]
    for loss in (lambda: cosent(a, p, y, 0.3), lambda: regression(a, p, y)):
        _, ga, gp = loss()
        cases.append((loss, [(a, ga), (p, gp)]))
    for fn, parts in cases:
        for x, g in parts:
            for i in range(x.size):
                at = np.unravel_index(i, x.shape)
                old = x[at]
                x[at] = old + 1e-6
                up = fn()[0]
                x[at] = old - 1e-6
                down = fn()[0]
                x[at] = old
                assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_schedule_and_ranks():
    lr = [learning_rate(s, 100, 1.0, 0.1) for s in range(100)]
    assert lr[0] == 0.1 and lr[9] == 1.0 and lr[10] == 1.0 and lr[-1] < 0.01
    assert spearman([1, 2, 2, 3], [1, 2, 2, 3]) == pytest.approx(1)
    assert np.isnan(spearman([1], [1])) and spearman([1, 1], [1, 2]) == 0


SAME = [("a man plays a guitar", "a person plays guitar"), ("the cat sleeps on a mat", "a cat is sleeping on the mat"), ("kids run in a park", "children run in the park"), ("she cooks a soup", "a woman cooks soup"), ("a dog barks at night", "the dog barks in the night"), ("rain falls on a roof", "the rain falls on roofs")]


def _pairs():
    near = [Pair(a, b, 0.9) for a, b in SAME]
    far = [Pair(SAME[i][0], SAME[(i + 2) % 6][1], 0.05) for i in range(6)]
    return (near + far) * 4


@pytest.mark.parametrize("loss", ["contrastive", "cosent", "regression"])
def test_training_improves(loss):
    from quern.cli import make_model, tokenise

    noise = [Pair("x y z", "q r s", 0.9), Pair("k l m", "k l m n", 0.05)] * 4
    o = Options(rank=6, alpha=12, targets="all", loss=loss, epochs=4, batch=8, rate=5e-3, negatives=1, dims=(16,), learn_temperature=True, max_tokens=16, seeds=(1,), output_bias=True)
    t = Trainer(make_model("bert-tiny"), tokenise, o)
    pairs = _pairs() + noise
    base = t.metrics(pairs, None)["spearman"]
    report = t.train(pairs)
    assert t.metrics(pairs, report.adapter)["spearman"] >= base + 0.02
    assert len(report.epochs) == 4


def test_early_stop_logs_and_whitening_is_saved():
    from quern.cli import make_model, tokenise

    said = []
    o = Options(epochs=6, batch=8, rate=0.0, patience=1, log=said.append, whiten=True, seeds=(1, 2))
    report = Trainer(make_model("gemma-tiny"), tokenise, o).train(_pairs()[:16])
    assert len(said) == 2 and len(report.epochs) == 4
    assert report.adapter.whitening.shape == (48, 48)


def test_a_new_adapter_changes_nothing():
    a = new_adapter(BERT, 2)
    assert np.allclose(BERT.embed([1, 2, 3], a), BERT.embed([1, 2, 3]))
    assert a.parameters() == sum(x.size + y.size for x, y in a.weights.values())
