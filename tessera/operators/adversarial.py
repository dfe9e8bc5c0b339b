"""A network whose features should tell the class but not the dataset: gradients of the dataset head are reversed.

Layers are numpy; fitting takes a sample of bounded size on the driver, scoring runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import load_arrays, save_arrays

#: Bytes that the sample takes on the driver at most, with 4 for a component.
SAMPLE_BYTES = 256 << 20


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tanh form of the Gaussian error linear unit, and its slope."""
    inner = np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)
    t = np.tanh(inner)
    slope = np.sqrt(2 / np.pi) * (1 + 3 * 0.044715 * x**2)
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * slope


def _relu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(x, 0), (x > 0).astype(x.dtype)


class Network:
    """Dense layers, an activation after each but the last; weights in `layers` as (matrix, bias)."""

    def __init__(self, sizes: list[int], activation: str, dropout: float, last_active: bool, rng: np.random.Generator):
        self.layers = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes, sizes[1:])]
        self.active = {"gelu": _gelu, "relu": _relu}[activation]
        self.dropout, self.last_active, self.rng = dropout, last_active, rng

    def forward(self, x: np.ndarray, train: bool = False) -> np.ndarray:
        self.trace = []
        for at, (w, b) in enumerate(self.layers):
            z, slope, kept = x @ w + b, None, None
            if at + 1 < len(self.layers) or self.last_active:
                z, slope = self.active(z)
                if train and self.dropout:
                    kept = (self.rng.random(z.shape) >= self.dropout) / (1 - self.dropout)
                    z = z * kept
            self.trace.append((x, slope, kept))
            x = z
        return x

    def backward(self, gradient: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The gradient by the input, and those by the weights in the order of parameters()."""
        out: list[np.ndarray] = []
        for (w, _), (x, slope, kept) in zip(self.layers[::-1], self.trace[::-1]):
            gradient = gradient if kept is None else gradient * kept
            gradient = gradient if slope is None else gradient * slope
            out = [x.T @ gradient, gradient.sum(axis=0), *out]
            gradient = gradient @ w.T
        return gradient, out

    def parameters(self) -> list[np.ndarray]:
        return [array for layer in self.layers for array in layer]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def macro_f1(y: np.ndarray, predicted: np.ndarray) -> float:
    """The mean of both classes' F1, 0 for one without rows and predictions."""
    hits = [((predicted == k) & (y == k)).sum() for k in (0, 1)]
    sizes = [(predicted == k).sum() + (y == k).sum() for k in (0, 1)]
    return float(np.mean([2 * h / n if n else 0.0 for h, n in zip(hits, sizes)]))


class Adversarial:
    """Fitted on at most sample_rows rows (run_id, x, y, dataset_id), the smallest hashes of their ids, and at most
    SAMPLE_BYTES of them; scores() adds `score`, larger for class 1.

    Shared layers lead to a class head and a dataset head of two layers each. Mini-batches by AdamW with clipped
    gradients; the dataset head's gradient comes back reversed, weighted from 0 up to 1 over the first half of the epochs.
    A held-back share of the sample stops the fit when its macro F1 hasn't risen for `patience` epochs; the best epoch's
    weights stay. Inputs are scaled: l2, standard, maxabs or none.
    """

    def __init__(self, hidden: tuple[int, ...] = (512, 256, 64), activation: str = "gelu", dropout: float = 0.1, rate: float = 1e-4, decay: float = 0.00027, batch: int = 1024, epochs: int = 100, patience: int = 10, held_back: float = 0.15, domain_weight: float = 0.0, normalize: str = "maxabs", clip: float | None = 0.1, sample_rows: int = 20_000, seed: int = 42):
        self.settings = dict(hidden=list(hidden), activation=activation, dropout=dropout, rate=rate, decay=decay, batch=batch, epochs=epochs, patience=patience, held_back=held_back, domain_weight=domain_weight, normalize=normalize, clip=clip, sample_rows=sample_rows, seed=seed)
        self.shift, self.scale, self.nets = np.zeros(0), np.zeros(0), None
        self.datasets: list[str] = []
        self.history: list[dict[str, float]] = []

    def clone(self) -> "Adversarial":
        return Adversarial(**self.settings)

    def _nets(self, d: int) -> tuple[Network, Network, Network]:
        s, rng = self.settings, np.random.default_rng(self.settings["seed"])
        hidden = s["hidden"]
        make = lambda sizes, last: Network(sizes, s["activation"], s["dropout"], last, rng)
        return make([d, *hidden], True), make([hidden[-1], hidden[-1], 1], False), make([hidden[-1], hidden[-1], len(self.datasets)], False)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        if self.settings["normalize"] == "l2":
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return (x - self.shift) / self.scale

    def fit(self, xy: DataFrame) -> "Adversarial":
        s = self.settings
        d = (xy.select(F.size("x").alias("d")).first() or {"d": 1})["d"]
        limit = max(1, min(s["sample_rows"], SAMPLE_BYTES // (4 * d)))
        rows = xy.select("run_id", F.col("x").cast("array<float>").alias("x"), "y", F.col("dataset_id").cast("string").alias("dataset_id")).orderBy(F.xxhash64("run_id"), "run_id").limit(limit).toPandas().sort_values("run_id")
        x, y = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), d), rows["y"].to_numpy(int)
        if len(set(y.tolist())) < 2:
            raise ValueError("both classes are needed")
        self.datasets = sorted(set(rows["dataset_id"]))
        domain = np.searchsorted(self.datasets, rows["dataset_id"].to_numpy(str))
        self.shift, self.scale = np.zeros(d), np.ones(d)
        if s["normalize"] == "maxabs":
            self.scale = np.abs(x).max(axis=0)
        elif s["normalize"] == "standard":
            self.shift, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(self.scale == 0, 1.0, self.scale)
        x = self._scaled(x)
        self.nets, self.history = self._nets(d), []
        order = np.random.default_rng(s["seed"] + 1).permutation(len(x))
        cut = int(len(x) * s["held_back"])
        self._train(x, y, domain, order[cut:], order[:cut])
        return self

    def _train(self, x: np.ndarray, y: np.ndarray, domain: np.ndarray, own: np.ndarray, held: np.ndarray) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings["seed"] + 2)
        features, to_class, to_domain = self.nets
        weights = [array for net in self.nets for array in net.parameters()]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        best, kept, waited, step = 0.0, None, 0, 0
        for epoch in range(s["epochs"]):
            reverse = min(1.0, 2 / (1 + np.exp(-10 * epoch / (s["epochs"] / 2))) - 1)
            losses = []
            shuffled = rng.permutation(own)
            for at in range(0, len(shuffled), s["batch"]):
                part = shuffled[at : at + s["batch"]]
                h = features.forward(x[part], True)
                p = _sigmoid(to_class.forward(h, True)[:, 0])
                z = to_domain.forward(h, True)
                q = np.exp(z - z.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                losses.append((-np.log(np.where(y[part] == 1, p, 1 - p) + 1e-12).mean(), -np.log(q[np.arange(len(part)), domain[part]] + 1e-12).mean()))
                by_class, of_class = to_class.backward(((p - y[part]) / len(part))[:, None])
                q[np.arange(len(part)), domain[part]] -= 1
                by_domain, of_domain = to_domain.backward(s["domain_weight"] * q / len(part))
                _, of_features = features.backward(by_class - reverse * by_domain)
                gradients = of_features + of_class + of_domain
                norm = np.sqrt(sum((g * g).sum() for g in gradients))
                shrink = min(1.0, s["clip"] / (norm + 1e-6)) if s["clip"] else 1.0
                step += 1
                for w, g, m, v in zip(weights, gradients, first, second):
                    m += 0.1 * (g * shrink - m)
                    v += 0.001 * ((g * shrink) ** 2 - v)
                    w *= 1 - s["rate"] * s["decay"]
                    w -= s["rate"] * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            class_loss, domain_loss = np.mean(losses, axis=0)
            f1 = macro_f1(y[held], (self._probabilities(x[held]) > 0.5).astype(int)) if len(held) else 0.0
            self.history.append({"class_loss": float(class_loss), "domain_loss": float(domain_loss), "f1": f1, "reverse": float(reverse)})
            if f1 > best:
                best, kept, waited = f1, [w.copy() for w in weights], 0
            else:
                waited += 1
            if len(held) and waited >= s["patience"]:
                break
        for w, at_best in zip(weights, kept or weights):
            w[...] = at_best

    def _probabilities(self, scaled: np.ndarray) -> np.ndarray:
        features, to_class, _ = self.nets
        return _sigmoid(to_class.forward(features.forward(scaled))[:, 0])

    def scores(self, xy: DataFrame) -> DataFrame:
        shared = xy.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            for x in batches:
                rows = np.array(x.tolist(), float).reshape(len(x), len(model.scale))
                yield pd.Series(np.concatenate([np.zeros(0), *(model._probabilities(model._scaled(rows[at : at + 1024])) for at in range(0, len(rows), 1024))]))

        return xy.withColumn("score", score("x"))

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {f"{n}.{at}": array for n, net in enumerate(self.nets) for at, array in enumerate(net.parameters())}
        save_arrays(spark, path, {"shift": self.shift, "scale": self.scale} | arrays, {"settings": self.settings, "datasets": self.datasets})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Adversarial":
        arrays, own = load_arrays(spark, path)
        model = cls(**own["settings"])
        model.datasets, model.shift, model.scale = own["datasets"], arrays["shift"], arrays["scale"]
        model.nets = model._nets(len(model.scale))
        for n, net in enumerate(model.nets):
            for at, array in enumerate(net.parameters()):
                array[...] = arrays[f"{n}.{at}"]
        return model
