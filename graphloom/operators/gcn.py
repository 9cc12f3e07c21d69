"""Two or more graph-convolution layers as DataFrame plans: inference, gradients, training, averaging.

The plan builder picks the cheap side of the product (the narrower of a layer's two widths goes along
the edges) and factors edge scales into vertex scales; Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import metrics
from graphloom.operators import vectors as V
from graphloom.operators.messages import propagate, propagate_per_edge
from graphloom.plans.prepared import PreparedGraph
from graphloom.plans.staging import staged

Matrix = V.Matrix


@dataclass(frozen=True)
class GcnConfig:
    """Settings of a run; the names are those of the configuration files."""

    num_layers: int = 2
    num_labels: int = 10
    input_dim: int = 64
    hidden_dim: int = 16
    num_samples: int = 0
    num_edges: int = 0
    learning_rate: float = 0.5
    train_ratio: float = 0.2
    val_ratio: float = 0.2
    test_ratio: float = 0.6

    def widths(self) -> list[int]:
        return [self.input_dim, *[self.hidden_dim] * (self.num_layers - 1), self.num_labels]

    def weights(self) -> list[Matrix]:
        w = self.widths()
        return [V.glorot_weights(a, b) for a, b in zip(w, w[1:])]


def layer(g: PreparedGraph, h: DataFrame, w: Matrix, order: str = "auto") -> DataFrame:
    """S (A + I) S (h w), with the product before or after the propagation: both are the same numbers."""
    wide, narrow = len(w), len(w[0])
    first = order == "matmul_first" or order == "auto" and narrow <= wide
    if first:
        return propagate(g, h.select("vid", V.times_matrix(F.col("h"), w).alias("h")), narrow)
    return propagate(g, h, wide).select("vid", V.times_matrix(F.col("h"), w).alias("h"))


def features(g: PreparedGraph) -> DataFrame:
    return g.vertices.select("vid", F.col("feature").alias("h"))


def forward(g: PreparedGraph, weights: list[Matrix], kernel: str = "optimized") -> list[DataFrame]:
    """The pre-activations Z of every layer, as (vid, h).

    ``optimized`` and ``delayed`` agree: one scales before the sum and after it, the other after the
    product of the sum. ``original`` scales every edge, on features scaled once at load.
    """
    h = features(g)
    if kernel == "original":
        h = h.join(g.scale, "vid").select("vid", V.scaled(F.col("h"), F.col("s")).alias("h"))
    out = []
    for k, w in enumerate(weights):
        if kernel == "optimized":
            z = layer(g, h, w)
        elif kernel == "delayed":
            z = propagate(g, h, len(w), post=False).join(g.scale, "vid").select("vid", V.scaled(V.times_matrix(F.col("h"), w), F.col("s")).alias("h"))
        elif kernel == "original":
            z = propagate_per_edge(g, h, len(w)).select("vid", V.times_matrix(F.col("h"), w).alias("h"))
        else:
            raise ValueError(f"unknown kernel {kernel!r}")
        out.append(z)
        if k + 1 < len(weights):
            h = z.select("vid", V.relu(F.col("h")).alias("h"))
    return out


def predict(g: PreparedGraph, weights: list[Matrix], kernel: str = "optimized") -> DataFrame:
    """(vid, p): class probabilities. A single lazy plan, whatever the number of layers."""
    return forward(g, weights, kernel)[-1].select("vid", V.softmax(F.col("h")).alias("p"))


def _kept(cut: bool):
    return staged if cut else lambda df, name: df


def _per_row(d: DataFrame, sizes: DataFrame) -> DataFrame:
    """A tile's summed gradient over its number of training rows; a tile without any has none."""
    return d.join(sizes, "tid").select("tid", "i", "j", F.when(F.col("train_n") > 0, F.col("w") / F.col("train_n")).otherwise(F.lit(0.0)).alias("w"))


def _train_sizes(g: PreparedGraph, train: float) -> DataFrame:
    return metrics.reordered_index(g).groupBy("tid").agg(F.first(F.floor(F.col("n") * float(train))).alias("train_n"))


def _back_through(e: DataFrame, w: Matrix) -> DataFrame:
    return e.select("vid", V.times_matrix(F.col("h"), [list(c) for c in zip(*w)]).alias("h"))


def _gated(e: DataFrame, z: DataFrame) -> DataFrame:
    return e.select("vid", F.col("h").alias("g")).join(z.select("vid", F.col("h").alias("z")), "vid").select("vid", V.relu_gate(F.col("g"), F.col("z")).alias("h"))


def gradients(g: PreparedGraph, weights: list[Matrix], train: float = 0.2, grad: str = "full", cut: bool = True, kernel: str = "optimized", first: int = 0) -> list[DataFrame]:
    """(tid, i, j, w) per layer from ``first`` on: each tile's own weight gradient, over its number of training rows.

    ``full`` propagates the error through every layer; ``optimized`` hands E W' down without the hop.
    The kernels ``original`` and ``delayed`` know the full rule only. Layers below ``first`` are not built.
    """
    if kernel != "optimized":
        return _gradients_of_sums(g, weights, train, cut, kernel, first)
    keep = _kept(cut)
    zs = [keep(z, f"gcn-z{k}") for k, z in enumerate(forward(g, weights))]
    hs = [features(g), *[z.select("vid", V.relu(F.col("h")).alias("h")) for z in zs[:-1]]]
    sizes = _train_sizes(g, train)
    error = keep(metrics.masked_error(zs[-1].select("vid", V.softmax(F.col("h")).alias("p")), g, train), "gcn-error").select("vid", "h")
    out: list[DataFrame] = []
    for k in range(len(weights) - 1, first - 1, -1):
        v = keep(propagate(g, error, len(weights[k][0])), f"gcn-v{k}")
        pair = hs[k].select("vid", F.col("h").alias("a")).join(v.select("vid", F.col("h").alias("b")), "vid").join(g.parts, "vid")
        out.append(_per_row(V.outer_sums(pair, "tid", "a", "b"), sizes))
        if k > first:
            error = _gated(_back_through(v if grad == "full" else error, weights[k]), zs[k - 1])
    return out[::-1]


def _gradients_of_sums(g: PreparedGraph, weights: list[Matrix], train: float, cut: bool, kernel: str, first: int) -> list[DataFrame]:
    """Gradients of the kernels that propagate before they multiply.

    The sums a layer multiplies are kept, so its gradient is their product with the error, without a hop; what
    goes down is E W', sent along the edges as wide as the layer's input and gated by the layer below.
    ``delayed`` scales around the sum. ``original`` scales each edge, the own row going forward only, on features
    scaled once at load: where its forward rule is not symmetric, this is its own rule, not the derivative.
    """
    if kernel not in ("original", "delayed"):
        raise ValueError(f"unknown kernel {kernel!r}")
    keep, original = _kept(cut), kernel == "original"
    h = features(g)
    if original:
        h = h.join(g.scale, "vid").select("vid", V.scaled(F.col("h"), F.col("s")).alias("h"))
    sums, zs = [], []
    for k, w in enumerate(weights):
        sums.append(keep(propagate_per_edge(g, h, len(w)) if original else propagate(g, h, len(w)), f"gcn-a{k}"))
        zs.append(sums[-1].select("vid", V.times_matrix(F.col("h"), w).alias("h")))
        h = zs[-1].select("vid", V.relu(F.col("h")).alias("h"))
    sizes = _train_sizes(g, train)
    error = keep(metrics.masked_error(zs[-1].select("vid", V.softmax(F.col("h")).alias("p")), g, train), "gcn-error").select("vid", "h")
    out: list[DataFrame] = []
    for k in range(len(weights) - 1, first - 1, -1):
        pair = sums[k].select("vid", F.col("h").alias("a")).join(error.select("vid", F.col("h").alias("b")), "vid").join(g.parts, "vid")
        out.append(_per_row(V.outer_sums(pair, "tid", "a", "b"), sizes))
        if k > first:
            down = _back_through(error, weights[k])
            hop = propagate_per_edge(g, down, len(weights[k]), forward=False) if original else propagate(g, down, len(weights[k]))
            error = keep(_gated(hop, zs[k - 1]), f"gcn-e{k - 1}")
    return out[::-1]


def sgd_step(w: DataFrame, d: DataFrame, rate: float) -> DataFrame:
    """(tid, i, j, w) - rate * gradient; ``w`` has i, j, w."""
    return d.select("tid", "i", "j", F.col("w").alias("d")).join(w.select("i", "j", "w"), ["i", "j"]).select("tid", "i", "j", (F.col("w") - F.lit(rate) * F.col("d")).alias("w"))


def average_weights(w: DataFrame) -> DataFrame:
    """(i, j, w): the plain mean over the tiles."""
    return w.groupBy("i", "j").agg(F.avg("w").alias("w"))


def weight_frame(spark, w: Matrix) -> DataFrame:
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(w) for j, x in enumerate(row)], "i long, j long, w double")


def train(g: PreparedGraph, config: GcnConfig, epochs: int, grad: str = "full", weights: list[Matrix] | None = None, kernel: str = "optimized", watch: Callable[[int, list[Matrix]], None] | None = None) -> list[Matrix]:
    """Weights after ``epochs`` epochs of per-tile steps and averaging. Only weights, as large as the model, reach the driver.

    ``watch`` sees the number of epochs done and the weights then, first before any.
    """
    spark = g.vertices.sparkSession
    weights = weights or config.weights()
    if watch is not None:
        watch(0, weights)
    for done in range(1, epochs + 1):
        new = []
        for w, d in zip(weights, gradients(g, weights, config.train_ratio, grad, kernel=kernel)):
            mean = average_weights(sgd_step(weight_frame(spark, w), d, config.learning_rate))
            m = [[0.0] * len(w[0]) for _ in w]
            for r in mean.collect():
                m[r["i"]][r["j"]] = r["w"]
            new.append(m)
        weights = new
        if watch is not None:
            watch(done, weights)
    return weights


def train_log(g: PreparedGraph, config: GcnConfig, epochs: int, path: str, grad: str = "full", kernel: str = "optimized") -> list[Matrix]:
    """Trains, and appends (epoch, tid, metric, value) to the Parquet table ``path`` before the first and after each epoch."""

    def note(done: int, weights: list[Matrix]) -> None:
        p = predict(g, weights, kernel)
        rows = metrics.accuracy_by_split(p, g, config.train_ratio, config.val_ratio).union(metrics.cross_entropy(p, g).select("tid", F.lit("cross_entropy").alias("metric"), F.col("loss").alias("value")))
        rows.select(F.lit(done).cast("long").alias("epoch"), "tid", "metric", "value").write.mode("append").parquet(path)

    return train(g, config, epochs, grad, kernel=kernel, watch=note)


#: What each iteration of an epoch does, by kernel: whether messages pass, and the width they have.
def schedule(config: GcnConfig, kernel: str = "optimized") -> list[tuple[str, bool, int]]:
    hidden, labels = config.hidden_dim, config.num_labels
    if kernel == "original":
        return [("forward", True, config.input_dim), ("forward", True, hidden), ("error", False, 0), ("backward", True, hidden)]
    return [("forward", True, hidden), ("forward", True, labels), ("error", False, 0), ("backward", True, labels), ("gate", False, 0), ("backward", True, hidden)]
