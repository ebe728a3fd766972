"""Classification heads of any depth, trained by mini-batches whose gradients Spark sums.

The rows are stored once in as many folders as an epoch has batches, by a hash of their key, so
that a step reads its batch alone. Each task returns the sum of the gradients of its rows; a
tree of sums leaves a few for the driver, which holds the parameters and takes a step of Adam.
What is sent is the model, whose size is set by its shape, never rows.

Small batches need no sums over tasks, and their steps follow each other anyway: a task takes
those of CHUNK_BYTES of features (of CHUNK_ROWS rows at least), one after the other. Each epoch
deals the rows to its tasks once, in its order of the batches. The parameters and Adam's moments
travel from task to task as blocks in the shared folder, so the driver holds none of them.

The loss is the cross entropy with smoothed labels and class weights: the target of a row has
1 - s + s / K at its class and s / K at the others, each class counts with its weight, and the
sum is divided by the sum of the weights of the rows' classes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.session import new_path, remove_path

CHUNK_ROWS, BLOCK = 4096, 1 << 15  # least rows of a task with small batches, parameters of a block
CHUNK_BYTES = 1 << 24  # of the features of such a task, where that is more
SCORED_ROWS, CACHED = 512, 1 << 16  # rows scored at once, parameters of a step that stay in the cache
STATE = "number int, w binary, m binary, v binary"
AT_ONCE = 16  # sums that the driver gets at a time
FIELDS = "loss double, weight double, rows long, gradient binary"


#: Cody's rational approximations of the error function, from the highest power: up to
#: 0.46875, of its complement up to 4, and above.
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
     2.33520497626869185e-3),
)


def _ratio(x: np.ndarray, powers: tuple[tuple[float, ...], tuple[float, ...]]) -> np.ndarray:
    return np.polyval(powers[0], x) / np.polyval(powers[1], x)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, within a few units of the last place."""
    flat = np.asarray(x, dtype=np.float64).ravel()
    size, out = np.abs(flat), np.where(np.isnan(flat), np.nan, 1.0)
    near, far = size <= 0.46875, (size > 4) & (size < 6)
    y = size[near]
    out[near] = y * _ratio(y * y, _ERF)
    y = size[mid := (size > 0.46875) & (size <= 4)]
    out[mid] = 1 - np.exp(-y * y) * _ratio(y, _ERFC)
    y = size[far]
    z = 1 / (y * y)
    out[far] = 1 - np.exp(-y * y) / y * (1 / math.sqrt(math.pi) - z * _ratio(z, _ERFC_TAIL))
    return np.copysign(out, flat).reshape(np.shape(x))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below = 0.5 * (1 + _erf(x / math.sqrt(2)))
    return x * below, below + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _silu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _logistic(x)
    return x * s, s * (1 + x * (1 - s))


def _mish(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.tanh(np.logaddexp(0, x))
    return x * t, t + x * (1 - t * t) * _logistic(x)


def _sigmoid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _logistic(x)
    return s, s * (1 - s)


def _tanh(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.tanh(x)
    return t, 1 - t * t


def _leaky(slope: float):
    return lambda x: (np.where(x > 0, x, slope * x), np.where(x > 0, 1.0, slope))


#: Value and derivative of each activation.
ACTIVATIONS = {
    "Tanh": _tanh,
    "ReLU": _leaky(0.0),
    "LeakyReLU": _leaky(0.01),
    "Sigmoid": _sigmoid,
    "GELU": _gelu,
    "SiLU": _silu,
    "Mish": _mish,
}


@dataclass(frozen=True)
class HeadShape:
    """``layers`` linear maps; between them ``hidden`` units and the activation."""

    inputs: int
    layers: int = 1
    hidden: int = 16
    classes: int = 3
    bias: bool = True
    activation: str = "ReLU"
    smoothing: float = 0.0
    class_weights: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.layers < 1:
            raise ValueError("layers must be at least 1")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"no activation {self.activation}")

    @property
    def sizes(self) -> list[int]:
        return [self.inputs, *[self.hidden] * (self.layers - 1), self.classes]

    @property
    def parts(self) -> list[tuple[int, ...]]:
        """Shapes of the parameters: a matrix for each layer, and its bias."""
        pairs = list(zip(self.sizes, self.sizes[1:], strict=False))
        return [s for a, b in pairs for s in ([(a, b), (b,)] if self.bias else [(a, b)])]

    @property
    def weights(self) -> np.ndarray:
        return np.ones(self.classes) if self.class_weights is None else np.array(self.class_weights)

    def drawn(self, seed: int) -> np.ndarray:
        """First parameters, in one array: uniform within one over the root of the inputs."""
        draw, out = np.random.default_rng(seed), []
        bound = 1.0
        for shape in self.parts:
            bound = 1 / math.sqrt(shape[0]) if len(shape) == 2 else bound
            out.append(draw.uniform(-bound, bound, shape).ravel())
        return np.concatenate(out)

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
        cuts = np.cumsum([math.prod(s) for s in self.parts])[:-1]
        parts = [p.reshape(s) for p, s in zip(np.split(flat, cuts), self.parts, strict=True)]
        return list(zip(parts[::2], parts[1::2], strict=True)) if self.bias else [(p, None) for p in parts]


def logits(shape: HeadShape, flat: np.ndarray, x: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Outputs of the last layer; ``kept`` gets each layer's input and the slopes that led to it."""
    slope = None
    layers = shape.split(flat)
    for k, (w, b) in enumerate(layers):
        if kept is not None:
            kept.append((x, slope))
        x = x @ w if b is None else x @ w + b
        if k + 1 < len(layers):
            x, slope = ACTIVATIONS[shape.activation](x)
    return x


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def summed_loss(shape: HeadShape, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Sum of the losses, sum of the rows' weights, and the gradient of the former."""
    kept: list = []
    logp = log_softmax(logits(shape, flat, x, kept))
    target = np.full((len(y), shape.classes), shape.smoothing / shape.classes)
    target[np.arange(len(y)), y] += 1 - shape.smoothing
    target *= shape.weights
    back = np.exp(logp) * target.sum(axis=1, keepdims=True) - target
    out = []
    for (w, b), (given, slope) in zip(reversed(shape.split(flat)), reversed(kept), strict=True):
        out.append([given.T @ back] + ([] if b is None else [back.sum(axis=0)]))
        if slope is not None:
            back = (back @ w.T) * slope
    gradient = np.concatenate([p.ravel() for layer in reversed(out) for p in layer])
    return float(-(target * logp).sum()), float(shape.weights[y].sum()), gradient


def _record(loss: float, weight: float, rows: int, gradient: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([loss]), pa.array([weight]), pa.array([rows], pa.int64()), pa.array([gradient.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["loss", "weight", "rows", "gradient"])


def _added(batches):
    loss = weight = 0.0
    rows, gradient = 0, None
    for batch in batches:
        for a, w, n, g in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            g = np.frombuffer(g)
            loss, weight, rows = loss + a, weight + w, rows + n
            gradient = g.copy() if gradient is None else gradient + g
    if gradient is not None:
        yield _record(loss, weight, rows, gradient)


def batch_gradient(rows: DataFrame, shape: HeadShape, flat: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Sums over all rows (x, y) of losses, weights and gradients."""
    sent = rows.sparkSession.sparkContext.broadcast(flat)

    def work(batches):
        total = [0.0, 0.0, 0, np.zeros(len(sent.value))]
        for batch in batches:
            y = batch.column(1).to_numpy()
            x = batch.column(0).flatten().to_numpy().reshape(len(y), -1)
            for at in range(0, len(y), 4096):
                part = summed_loss(shape, sent.value, x[at : at + 4096], y[at : at + 4096])
                total = [total[0] + part[0], total[1] + part[1], total[2] + len(y[at : at + 4096]), total[3] + part[2]]
        if total[2]:
            yield _record(*total)

    sums = rows.select("x", "y").mapInArrow(work, FIELDS)
    tasks = rows.rdd.getNumPartitions()
    while tasks > AT_ONCE:
        tasks = -(-tasks // AT_ONCE)
        sums = sums.repartition(tasks).mapInArrow(_added, FIELDS)
    loss, weight, gradient = 0.0, 0.0, np.zeros(len(flat))
    for r in sums.collect():
        loss, weight, gradient = loss + r["loss"], weight + r["weight"], gradient + np.frombuffer(r["gradient"])
    sent.destroy()
    return loss, weight, gradient


@dataclass
class NetworkHead:
    """An estimator: ``fit`` reads the columns ``features`` (array), ``label`` and ``key``.

    An epoch goes through all rows in batches of about ``batch`` rows (all at once if null).
    Rows whose features are null are left out; a label outside the classes stops the job.
    """

    shape: HeadShape
    key: str = "doc_id"
    features: str = "x"
    label: str = "label"
    epochs: int = 20
    batch: int | None = None
    rate: float = 0.01
    seed: int = 42
    watch: object = None  # called after each epoch with (epoch, model)

    def fit(self, df: DataFrame, params: dict | None = None) -> FittedHead:
        me = replace(self, **params) if params else self
        rows = df.where(F.col(me.features).isNotNull()).select(
            F.col(me.features).cast("array<double>").alias("x"),
            F.when(F.col(me.label).cast("int").between(0, me.shape.classes - 1), F.col(me.label).cast("long"))
            .otherwise(F.raise_error(F.lit("a label is no class")).cast("long"))
            .alias("y"),
            F.xxhash64(F.col(me.key).cast("string"), F.lit(me.seed)).alias("_draw"),
        )
        total = rows.count() if me.batch else 0
        batches = max(1, -(-total // me.batch)) if me.batch else 1
        path = new_path(df.sparkSession, "head-batches")
        rows = rows.withColumn("part", F.pmod(F.col("_draw"), F.lit(batches)).cast("int"))
        if me.batch and me.batch <= CHUNK_ROWS:
            rows.write.parquet(path)  # batches are many, so none has a folder
            model = me._fit_in_tasks(df.sparkSession.read.schema(", ".join(_ROW)).parquet(path), batches)
            remove_path(df.sparkSession, path)
            return model
        rows.write.partitionBy("part").parquet(path)
        stored = df.sparkSession.read.schema(", ".join(_ROW)).parquet(path)
        flat = me.shape.drawn(me.seed)
        first, second, steps, history = np.zeros_like(flat), np.zeros_like(flat), 0, []
        draw = np.random.default_rng(me.seed)
        for epoch in range(me.epochs):
            sums = [0.0, 0.0]
            for part in draw.permutation(batches).tolist():
                loss, weight, gradient = batch_gradient(stored.where(F.col("part") == part), me.shape, flat)
                sums = [sums[0] + loss, sums[1] + weight]
                if not weight:
                    continue  # by chance no row has this number
                steps += 1
                gradient /= weight
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient * gradient
                pace = first / (1 - 0.9**steps), second / (1 - 0.999**steps)
                flat = flat - me.rate * pace[0] / (np.sqrt(pace[1]) + 1e-8)
            history.append(sums[0] / sums[1] if sums[1] else math.nan)
            if me.watch:
                me.watch(epoch, FittedHead(me.shape, flat, me.features, history))
        return FittedHead(me.shape, flat, me.features, history)

    def _fit_in_tasks(self, stored: DataFrame, batches: int) -> FittedHead:
        draw, history, size = np.random.default_rng(self.seed), [], max(1, _chunk_rows(self.shape) // self.batch)
        state = _stored_state(_first_state(stored.sparkSession, self.shape, self.seed), "head-start")
        model = StoredHead(self.shape, state, self.features)
        for epoch in range(self.epochs):
            order = draw.permutation(batches).tolist()
            sums = np.zeros(2)
            dealt, path = _dealt(stored, order, size) if batches > size else (stored, None)
            for task, at in enumerate(range(0, batches, size)):
                chunk, old = order[at : at + size], state
                mine = dealt.where(F.col("task") == task) if path else dealt
                steps = _steps(mine, old[0], self.shape, chunk, self.rate)
                state = _stored_state(steps, "head-state")
                sums += np.frombuffer(state[0].where("number = -1").first()["w"])[1:]
                remove_path(stored.sparkSession, old[1])
            if path:
                remove_path(stored.sparkSession, path)
            history.append(sums[0] / sums[1] if sums[1] else math.nan)
            model = StoredHead(self.shape, state, self.features, history)
            if self.watch:
                try:
                    self.watch(epoch, model)
                except BaseException:
                    model.remove()
                    raise
        return model


@dataclass
class FittedHead:
    shape: HeadShape
    flat: np.ndarray
    features: str = "x"
    losses: list[float] = field(default_factory=list)  # of each epoch, before its steps

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (an array) and ``prediction`` (a double; null without features)."""
        shape, name = self.shape, self.features
        sent = df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("array<double>")
        def probability(vectors: pd.Series) -> pd.Series:
            known = vectors.notna().to_numpy()
            out = [None] * len(vectors)
            if known.any():
                x = np.stack(vectors[known].to_numpy()).astype(np.float64)
                found = np.exp(log_softmax(logits(shape, sent.value, x)))
                for i, p in zip(np.flatnonzero(known), found.tolist(), strict=True):
                    out[i] = p
            return pd.Series(out, dtype=object)

        p = F.col("probability")
        best = F.array_position(p, F.array_max(p)) - 1
        return df.withColumn("probability", probability(F.col(name).cast("array<double>"))).withColumn(
            "prediction", best.cast("double")
        )


class StoredHead(FittedHead):
    """A head whose parameters lie in the shared folder; ``flat`` brings them to the driver, for
    a ``transform``. It is valid while the training that made it takes no further step."""

    def __init__(self, shape: HeadShape, state: tuple[DataFrame, str], features: str, losses: Sequence[float] = ()):
        self.shape, self.state, self.features, self.losses = shape, state, features, list(losses)

    def remove(self) -> None:
        """Deletes the stored parameters."""
        remove_path(self.state[0].sparkSession, self.state[1])

    @property
    def flat(self) -> np.ndarray:
        rows = self.state[0].where("number >= 0").select("number", "w").orderBy("number").toLocalIterator()
        return np.concatenate([np.frombuffer(r["w"]) for r in rows])


def _blocks(number: int, arrays: Sequence[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int32()), *(pa.array([memoryview(a).tobytes()], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, names=["number", "w", "m", "v"])


def _state_rows(w: np.ndarray, m: np.ndarray | None, v: np.ndarray | None, totals: list[float]):
    """Blocks of parameters and moments (null: zeros), and the block -1: steps, loss, weight."""
    yield _blocks(-1, [np.array(totals)] + [np.zeros(0)] * 2)
    for number, at in enumerate(range(0, len(w), BLOCK)):
        part = w[at : at + BLOCK]
        yield _blocks(number, [part, *(np.zeros(len(part)) if x is None else x[at : at + BLOCK] for x in (m, v))])


def _first_state(spark: SparkSession, shape: HeadShape, seed: int) -> DataFrame:
    def work(batches):
        if sum(batch.num_rows for batch in batches):
            yield from _state_rows(shape.drawn(seed), None, None, [0.0, 0.0, 0.0])

    return spark.range(1, numPartitions=1).mapInArrow(work, STATE)


def _stored_state(state: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(state.sparkSession, name)
    state.write.parquet(path)
    return state.sparkSession.read.schema(STATE).parquet(path), path


def _filled(batch: pa.RecordBatch, arrays: Sequence[np.ndarray], totals: np.ndarray) -> None:
    """Copies the blocks of a batch, whose first columns are those of a state, to their places."""
    for k, number in enumerate(batch.column(0).to_pylist()):
        if number is None:
            continue
        for array, column in zip(arrays, batch.columns[1:], strict=False):
            part = np.frombuffer(column[k].as_buffer())
            if number < 0:
                totals[: len(part)] = part if len(part) else totals[:0]
            else:
                array[number * BLOCK : number * BLOCK + len(part)] = part


_ROW = ("x array<double>", "y long", "_draw long", "part int")


def _with_state(rows: DataFrame, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """State and rows in one frame: columns of the state, null in rows, and the other way round."""
    nulls = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")]
    absent = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _ROW]
    nulls = nulls[: len(columns)]  # ``columns`` are the first of the state's
    return state.select(*columns, *absent).union(rows.select(*nulls, "x", "y", "_draw", "part"))


def _rows_of(batch: pa.RecordBatch, first: int):
    """x, y, draw and part of the rows of a batch whose columns from ``first`` on they are."""
    batch = batch.filter(batch.column(first + 1).is_valid())
    if not batch.num_rows:
        return None
    y, drawn, part = (batch.column(first + i).to_numpy() for i in (1, 2, 3))
    return batch.column(first).flatten().to_numpy().reshape(len(y), -1), y, drawn, part


def _chunk_rows(shape: HeadShape) -> int:
    return max(CHUNK_ROWS, CHUNK_BYTES // (8 * shape.inputs))


def _dealt(stored: DataFrame, order: list[int], size: int) -> tuple[DataFrame, str]:
    """The rows with the number of their ``task``, and the path where each task has a folder: a
    task takes ``size`` of the batches in ``order``."""
    path, schema = new_path(stored.sparkSession, "head-epoch"), ", ".join(_ROW) + ", task int"
    task = np.empty(len(order), dtype=np.int32)
    task[order] = np.arange(len(order), dtype=np.int32) // size

    def work(batches):
        for batch in batches:
            yield batch.append_column("task", pa.array(task[batch.column(3).to_numpy()]))

    numbered = stored.select(*(c.split()[0] for c in _ROW)).mapInArrow(work, schema)
    numbered.repartition(-(-len(order) // size), "task").write.partitionBy("task").parquet(path)
    return stored.sparkSession.read.schema(schema).parquet(path), path


def _steps(rows: DataFrame, state: DataFrame, shape: HeadShape, chunk: list[int], rate: float) -> DataFrame:
    """The state after a step for each of the batches in ``chunk``, which ``rows`` are of, all
    in one task."""
    size = sum(math.prod(s) for s in shape.parts)

    def work(batches):
        w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        totals, found = np.zeros(3), []
        spare = np.empty(max(math.prod(s) for s in shape.parts))
        for batch in batches:
            _filled(batch, (w, m, v), totals)
            found.append(_rows_of(batch, 4))
        found = [f for f in found if f]
        steps, sums = int(totals[0]), [0.0, 0.0]
        if found:
            x, y, drawn, part = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((drawn, part))
            starts = np.searchsorted(part[order], chunk)
            ends = np.searchsorted(part[order], chunk, side="right")
            for start, end in zip(starts, ends, strict=True):
                mine = order[start:end]
                if not len(mine):
                    continue  # by chance no row has this number
                loss, weight = _step(shape, (w, m, v), x[mine], y[mine], steps + 1, rate, spare)
                sums = [sums[0] + loss, sums[1] + weight]
                steps += weight > 0
        yield from _state_rows(w, m, v, [float(steps), *sums])

    return _with_state(rows, state, ["number", "w", "m", "v"]).coalesce(1).mapInArrow(work, STATE)


def _step(
    shape: HeadShape, state: tuple, x: np.ndarray, y: np.ndarray, step: int, rate: float, spare: np.ndarray
) -> tuple[float, float]:
    """A step of Adam in place, layer by layer; the loss before it, and the weight. ``spare`` has
    room for the gradient of a layer, which would cost as much to get as to fill."""
    kept: list = []
    logp = log_softmax(logits(shape, state[0], x, kept))
    target = np.full((len(y), shape.classes), shape.smoothing / shape.classes)
    target[np.arange(len(y)), y] += 1 - shape.smoothing
    target *= shape.weights
    loss, weight = float(-(target * logp).sum()), float(shape.weights[y].sum())
    if not weight:
        return loss, weight
    back = np.exp(logp) * target.sum(axis=1, keepdims=True) - target
    layers = zip(*(reversed(shape.split(array)) for array in state), reversed(kept), strict=True)
    for (w, b), (mw, mb), (vw, vb), (given, slope) in layers:
        before = None if slope is None else (back @ w.T) * slope
        gradient = np.matmul(given.T, back, out=spare[: w.size].reshape(w.shape))
        _adam(w, mw, vw, gradient, weight, step, rate)
        if b is not None:
            _adam(b, mb, vb, back.sum(axis=0), weight, step, rate)
        back = before
    return loss, weight


def _adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, gradient: np.ndarray, weight: float, step: int, rate: float) -> None:
    """Stretch by stretch, so that what it writes is still in the cache when it is read again."""
    flat = [a.reshape(-1) for a in (w, m, v, gradient)]  # views, as none has gaps
    root = math.sqrt(1 - 0.999**step)
    for at in range(0, len(flat[0]), CACHED):
        w, m, v, gradient = (a[at : at + CACHED] for a in flat)
        gradient *= 0.1 / weight
        m *= 0.9
        m += gradient
        gradient *= gradient
        gradient *= 0.1
        v *= 0.999
        v += gradient
        np.sqrt(v, out=gradient)
        gradient += 1e-8 * root
        np.divide(m, gradient, out=gradient)
        gradient *= rate * root / (1 - 0.9**step)
        w -= gradient


def _stored_accuracy(model: StoredHead, df: DataFrame, label: str) -> float | None:
    """As ``predicted_accuracy``: groups of rows meet the blocks of the model in tasks."""
    shape, size = model.shape, sum(math.prod(s) for s in model.shape.parts)
    known = F.col(model.features).isNotNull() & F.col(label).isNotNull()
    right = F.when(F.col(label) == F.col(label).cast("long"), F.col(label).cast("long")).otherwise(F.lit(-1))
    rows = df.where(known).select(
        F.col(model.features).cast("array<double>").alias("x"), right.cast("long").alias("y"),
        F.lit(0).cast("long").alias("_draw"), F.lit(0).alias("part"),
    )
    groups = max(1, -(-rows.count() // _chunk_rows(shape)))
    both = _with_state(rows, model.state[0].where("number >= 0"), ["number", "w"])
    if groups > 1:
        each = F.sequence(F.lit(0), F.lit(groups - 1))
        drawn = F.array(F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        both = both.withColumn("_to", F.explode(F.when(F.col("number").isNotNull(), each).otherwise(drawn)))
        both = both.repartitionById(groups, F.col("_to")).drop("_to")
    else:
        both = both.coalesce(1)

    def work(batches):
        w, found = np.zeros(size), []
        for batch in batches:
            _filled(batch, (w,), np.zeros(3))
            found.append(_rows_of(batch, 2))
        hits = n = 0
        for x, y, _, _ in (f for f in found if f):
            for at in range(0, len(y), SCORED_ROWS):
                best = logits(shape, w, x[at : at + SCORED_ROWS]).argmax(axis=1)
                hits += int((best == y[at : at + SCORED_ROWS]).sum())
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64()), pa.array([n], pa.int64())], names=["hits", "n"])

    hits, n = both.mapInArrow(work, "hits long, n long").agg(F.sum("hits"), F.sum("n")).first()
    return hits / n if n else None


def predicted_accuracy(model: FittedHead, df: DataFrame, label: str = "label") -> float | None:
    """Share of the rows whose likeliest class is their label; null without rows."""
    if isinstance(model, StoredHead):
        return _stored_accuracy(model, df, label)
    hit = (F.col("prediction") == F.col(label)).cast("double")
    return model.transform(df).agg(F.avg(hit)).first()[0]


def weights_of(codes: dict[int, float], classes: Sequence[int] = (0, 1, 2)) -> tuple[float, ...]:
    return tuple(codes.get(c, 1.0) for c in classes)
