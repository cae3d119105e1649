"""Densities over tokens: the exact token histogram, and a masked autoregressive network (MADE) in NumPy."""

from __future__ import annotations

import logging
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.operators.encoding import Predicate, TableEncoder, enumeration_size, token_digest
from cardscope.session import at_once, cut_lineage

_LOG = logging.getLogger(__name__)
#: Different rows of tokens that are trained on the driver, and that a part holds otherwise; draws of an epoch, from all rows.
LOCAL_CELLS, EPOCH_DRAWS = 200_000, 200_000
#: Predicates that one pass over a histogram evaluates.
BLOCK = 200


def token_histogram(df: DataFrame, encoder: TableEncoder) -> DataFrame:
    """(t0, t1, …, rows): how often each combination of tokens occurs; combined map-side."""
    names = [f"t{i}" for i in range(len(encoder.columns))]
    return encoder.encode(df).groupBy(*names).agg(F.count("*").alias("rows"))


def _selected(allowed: dict[int, list[int]], constrained: set[int]) -> Column:
    out = F.lit(True)
    for i in sorted(constrained):
        out = out & (F.col(f"t{i}").isin(allowed[i]) if allowed[i] else F.lit(False))
    return out


def histogram_estimates(histogram: DataFrame, encoder: TableEncoder, requests: dict[str, list[Predicate]]) -> DataFrame:
    """(query_id, selectivity, cardinality): each request's share of the histogram, all requests of a block in one pass.

    A request without predicates is the whole table. An empty histogram has selectivity 0."""
    spark, names = histogram.sparkSession, list(requests)
    out: DataFrame | None = None
    for k in range(0, len(names), BLOCK):
        sums = []
        for n in names[k : k + BLOCK]:
            ps = requests[n]
            hit = _selected(encoder.allowed(ps), {encoder.column_index(p.column) for p in ps})
            sums.append(F.struct(F.lit(n).alias("query_id"), F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("hits"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total")).alias(f"s{len(sums)}"))
        part = histogram.agg(*sums).select(F.explode(F.array(*(f"s{i}" for i in range(len(sums))))).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id string, selectivity double, cardinality double")
    share = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0)
    return out.select("query_id", share.alias("selectivity"), (share * encoder.row_count).alias("cardinality"))


class Made:
    """Masked autoregressive network: an embedding per column, masked ReLU layers, a softmax per column over its tokens.

    Outputs of column i depend on the tokens of columns before i only. Hidden degrees are drawn from 1 to C - 1, and are 1 for
    a table of one column, whose output then is its marginal distribution.
    """

    def __init__(self, domains: list[int], embedding: int = 16, hidden: tuple[int, ...] = (64, 64), seed: int = 123) -> None:
        if not domains:
            raise ValueError("a network needs at least one column")
        self.domains, self.embedding, self.hidden = list(domains), embedding, tuple(hidden)
        rng = np.random.default_rng(seed)
        c = len(domains)
        self.params: dict[str, np.ndarray] = {f"e{i}": rng.normal(0, 0.1, (d, embedding)) for i, d in enumerate(domains)}
        degrees = np.repeat(np.arange(1, c + 1), embedding)
        sizes = [c * embedding, *hidden, sum(domains)]
        self.masks: list[np.ndarray] = []
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            last = k == len(sizes) - 2
            after = np.repeat(np.arange(1, c + 1), domains) if last else rng.integers(1, max(c, 2), b)
            self.masks.append((after[:, None] > degrees[None, :] if last else after[:, None] >= degrees[None, :]).astype(float))
            self.params[f"w{k}"] = rng.normal(0, np.sqrt(2 / a), (b, a))
            self.params[f"b{k}"] = np.zeros(b)
            degrees = after
        self.cuts = np.concatenate([[0], np.cumsum(domains)])

    @property
    def layers(self) -> int:
        return len(self.masks)

    def _forward(self, tokens: np.ndarray) -> list[np.ndarray]:
        h = [np.concatenate([self.params[f"e{i}"][tokens[:, i]] for i in range(len(self.domains))], axis=1)]
        for k in range(self.layers):
            z = h[-1] @ (self.params[f"w{k}"] * self.masks[k]).T + self.params[f"b{k}"]
            h.append(np.maximum(z, 0) if k < self.layers - 1 else z)
        return h

    def conditionals(self, tokens: np.ndarray, column: int | None = None) -> list[np.ndarray]:
        """Probabilities by column for each row of tokens; only of one column if it is given."""
        logits = self._forward(tokens)[-1]
        out = []
        for i in range(len(self.domains)) if column is None else [column]:
            z = logits[:, self.cuts[i] : self.cuts[i + 1]]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def joint(self, tokens: np.ndarray) -> np.ndarray:
        p = np.ones(len(tokens))
        for i, q in enumerate(self.conditionals(tokens)):
            p *= q[np.arange(len(tokens)), tokens[:, i]]
        return p

    def loss_and_gradients(self, tokens: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood, summed over columns, and its gradient."""
        n = len(tokens)
        h = self._forward(tokens)
        delta, loss = np.empty_like(h[-1]), 0.0
        for i in range(len(self.domains)):
            z = h[-1][:, self.cuts[i] : self.cuts[i + 1]]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            loss -= float(np.log(np.maximum(p[np.arange(n), tokens[:, i]], 1e-300)).sum()) / n
            p[np.arange(n), tokens[:, i]] -= 1
            delta[:, self.cuts[i] : self.cuts[i + 1]] = p / n
        grads: dict[str, np.ndarray] = {}
        for k in reversed(range(self.layers)):
            grads[f"w{k}"] = (delta.T @ h[k]) * self.masks[k]
            grads[f"b{k}"] = delta.sum(axis=0)
            delta = delta @ (self.params[f"w{k}"] * self.masks[k])
            if k:
                delta *= h[k] > 0
        for i in range(len(self.domains)):
            g = np.zeros_like(self.params[f"e{i}"])
            np.add.at(g, tokens[:, i], delta[:, i * self.embedding : (i + 1) * self.embedding])
            grads[f"e{i}"] = g
        return loss, grads

    def loss(self, tokens: np.ndarray, rows: np.ndarray | None = None) -> float:
        """Mean negative log likelihood, of rows as often as they occur."""
        if not len(tokens):
            return 0.0
        each = np.concatenate([np.log(np.maximum(self.joint(tokens[k : k + 8192]), 1e-300)) for k in range(0, len(tokens), 8192)])
        return -float(np.average(each, weights=rows))


@dataclass
class TrainingSummary:
    epochs: int = 0
    best_epoch: int = 0
    best_validation_loss: float = float("inf")
    stopped_early: bool = False
    history: list[dict] = field(default_factory=list)


@dataclass
class Adam:
    """Moments of the gradients of a model's parameters."""

    rate: float
    step: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, g in grads.items():
            self.first[name] = 0.9 * self.first.get(name, 0.0) + 0.1 * g
            self.second[name] = 0.999 * self.second.get(name, 0.0) + 0.001 * g * g
            params[name] -= self.rate * (self.first[name] / (1 - 0.9**self.step)) / (np.sqrt(self.second[name] / (1 - 0.999**self.step)) + 1e-8)


def _epoch(model: Made, adam: Adam, tokens: np.ndarray, rows: np.ndarray | None, batch: int, draws: int, rng: np.random.Generator) -> list[float]:
    """Losses of one epoch: batches of a permutation, or with counts so many draws from the cells by how often they occur."""
    if rows is None:
        order = rng.permutation(len(tokens))
    else:
        upto = np.cumsum(rows)
        order = np.searchsorted(upto, rng.random(draws) * upto[-1], "right") if len(upto) and upto[-1] > 0 else np.zeros(0, np.int64)
    losses = []
    for k in range(0, len(order), batch):
        loss, grads = model.loss_and_gradients(tokens[order[k : k + batch]])
        losses.append(loss)
        adam.update(model.params, grads)
    return losses


def train(tokens: np.ndarray, domains: list[int], epochs: int = 20, batch: int = 1024, rate: float = 2e-3, validation: float = 0.1, embedding: int = 16, hidden: tuple[int, ...] = (64, 64), seed: int = 123, slow_epoch_seconds: float | None = None, least_epochs: int = 10, rows: np.ndarray | None = None, draws: int = EPOCH_DRAWS) -> tuple[Made, TrainingSummary]:
    """Adam on a random split; the parameters with the best validation loss are kept. After least_epochs an epoch slower
    than slow_epoch_seconds ends the training. rows: how often each combination of tokens occurs; an epoch then draws at most
    `draws` rows from all of them."""
    if tokens.ndim != 2:
        raise ValueError("tokens have the shape (rows, columns)")
    rng = np.random.default_rng(seed)
    model, note, adam = Made(domains, embedding, hidden, seed), TrainingSummary(), Adam(rate)
    if rows is None:
        order = rng.permutation(len(tokens))
        held = int(len(tokens) * validation)
        check, used, counts, check_rows = tokens[order[:held]], tokens[order[held:]], None, np.ones(held)
    else:
        check_rows = rng.binomial(rows, validation)
        check, used, counts, draws = tokens, tokens, rows - check_rows, min(draws, int(rows.sum() - check_rows.sum()))
    best = {k: p.copy() for k, p in model.params.items()}
    for epoch in range(1, epochs + 1):
        began = time.time()
        losses = _epoch(model, adam, used, counts, batch, draws, rng)
        trained = float(np.mean(losses)) if losses else 0.0
        now = model.loss(check, check_rows) if check_rows.sum() else trained
        if _noted(note, epoch, trained, now):
            best = {k: p.copy() for k, p in model.params.items()}
        if slow_epoch_seconds is not None and epoch >= least_epochs and time.time() - began > slow_epoch_seconds:
            note.stopped_early = True
            break
    model.params = best
    return model, note


def _noted(note: TrainingSummary, epoch: int, trained: float, now: float) -> bool:
    """Keeps the losses of an epoch; whether it is the best so far."""
    _LOG.info("epoch %d: train loss %.5f, validation loss %.5f", epoch, trained, now)
    note.history.append({"epoch": epoch, "train_loss": trained, "validation_loss": now})
    note.epochs = epoch
    if now < note.best_validation_loss:
        note.best_validation_loss, note.best_epoch = now, epoch
        return True
    return False


def train_parted(cells: DataFrame, domains: list[int], cells_count: int, epochs: int = 20, batch: int = 1024, rate: float = 2e-3, validation: float = 0.1, embedding: int = 16, hidden: tuple[int, ...] = (64, 64), seed: int = 123, part_cells: int = LOCAL_CELLS, draws: int = EPOCH_DRAWS) -> tuple[Made, TrainingSummary]:
    """A network from cells (t0, t1, …, rows) of any number, by local training and averaging.

    Cells are kept in parts of about part_cells. In an epoch every part goes on from the common parameters with draws from its own
    rows, and the parameters and moments of all parts are averaged by their rows, in groups first, so that the driver
    receives a bounded number of them. The validation loss is over a share of the rows of every part."""
    names = [f"t{i}" for i in range(len(domains))]
    number = max(1, -(-cells_count // part_cells))
    parts = cut_lineage(cells.withColumn("part", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(number)).cast("int")).repartition(number, "part"))
    sc, groups = cells.sparkSession.sparkContext, max(1, int(number**0.5))
    model, note, adam = Made(domains, embedding, hidden, seed), TrainingSummary(), Adam(rate)
    best = model.params

    def averaged(found: Iterator[tuple[float, bytes]]) -> tuple[float, tuple]:
        """Rows, and the mean by rows of (parameters, first, second, train loss, validation loss)."""
        total, mean = 0.0, None
        for rows, blob in found:
            params, first, second, *losses = pickle.loads(blob)
            flat = {("p", k): v for k, v in params.items()} | {("f", k): v for k, v in first.items()} | {("s", k): v for k, v in second.items()} | {("l", k): v for k, v in enumerate(losses)}
            total += rows
            mean = flat if mean is None else {k: v + (flat[k] - v) * (rows / total) for k, v in mean.items()}
        pick = lambda kind: {k: v for (x, k), v in mean.items() if x == kind}
        return total, (pick("p"), pick("f"), pick("s"), pick("l")[0], pick("l")[1])

    for epoch in range(1, epochs + 1):
        shared = sc.broadcast((model.params, adam.first, adam.second, adam.step))

        def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            params, first, second, step = shared.value
            mine = Made(domains, embedding, hidden, seed)
            mine.params = {k: v.copy() for k, v in params.items()}
            moments = Adam(rate, step, dict(first), dict(second))
            pdf = pdf.sort_values(names)
            tokens, rows = pdf[names].to_numpy(np.int64), pdf["rows"].to_numpy(np.int64)
            held = np.random.default_rng([seed, key[0]]).binomial(rows, validation)  # the same rows in every epoch
            left = rows - held
            # parts differ in rows only as far as hashing does; each takes its share of an epoch's draws, a batch at least
            losses = _epoch(mine, moments, tokens, left, batch, max(batch, draws // number), np.random.default_rng([seed, key[0], epoch]))
            here = mine.loss(tokens, held) if held.sum() else float(np.mean(losses or [0.0]))
            blob = pickle.dumps((mine.params, moments.first, moments.second, float(np.mean(losses or [0.0])), here))
            return pd.DataFrame({"grp": [key[0] % groups], "n": [float(max(left.sum(), 1))], "found": [blob]})

        def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total, mean = averaged(zip(pdf["n"], pdf["found"]))
            return pd.DataFrame({"grp": [key[0]], "n": [total], "found": [pickle.dumps(mean)]})

        schema = "grp int, n double, found binary"
        got = parts.groupBy("part").applyInPandas(local, schema).groupBy("grp").applyInPandas(join, schema).orderBy("grp").collect()
        _, (model.params, adam.first, adam.second, trained, now) = averaged((r["n"], r["found"]) for r in got)
        adam.step += -(-max(batch, draws // number) // batch)
        if _noted(note, epoch, trained, now):
            best = model.params
    model.params = best
    return model, note


def train_table(df: DataFrame, encoder: TableEncoder, local_cells: int = LOCAL_CELLS, **options) -> tuple[Made, TrainingSummary]:
    """A network for a table, from all of its rows: equal rows of tokens are one cell with a count, which loses nothing. Up to
    local_cells cells it is trained on the driver, beyond that in parts by the executors."""
    names = [f"t{i}" for i in range(len(encoder.columns))]
    cells = cut_lineage(token_histogram(df, encoder))
    number = cells.count()
    if number > local_cells:
        return train_parted(cells, encoder.domain_sizes, number, part_cells=local_cells, **options)
    # sorted, equal data and seed give an equal network
    found = cells.orderBy(*names).toPandas()
    return train(found[names].to_numpy(dtype=np.int64), encoder.domain_sizes, rows=found["rows"].to_numpy(dtype=np.int64), **options)


def train_many(spark: SparkSession, tables: dict[str, tuple[DataFrame, TableEncoder]], local_cells: int = LOCAL_CELLS, **options) -> dict[str, tuple[Made, TrainingSummary]]:
    """`train_table` of many tables: the cells of each that has few go to one task, and those tasks run beside each other."""
    cells = dict(zip(tables, at_once([lambda df=df, e=e: cut_lineage(token_histogram(df, e)) for df, e in tables.values()])))
    numbers = dict(zip(tables, at_once([c.count for c in cells.values()])))
    out, todo = {}, []
    for t, (_, encoder) in tables.items():
        names = [f"t{i}" for i in range(len(encoder.columns))]
        if numbers[t] > local_cells:
            out[t] = train_parted(cells[t], encoder.domain_sizes, numbers[t], part_cells=local_cells, **options)
        else:
            found = cells[t].orderBy(*names).toPandas()
            todo.append((t, pickle.dumps((found[names].to_numpy(dtype=np.int32), encoder.domain_sizes, found["rows"].to_numpy(dtype=np.int64)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for t, blob in zip(pdf["t"], pdf["data"]):
                tokens, domains, rows = pickle.loads(blob)
                done.append((t, pickle.dumps(train(tokens.astype(np.int64), domains, rows=rows, **options))))
            yield pd.DataFrame(done, columns=["t", "model"])

    if todo:
        given = spark.createDataFrame(todo, "t string, data binary").repartitionByRange(len(todo), "t")
        out |= {r["t"]: pickle.loads(r["model"]) for r in given.mapInPandas(run, "t string, model binary").collect()}
    return out


@dataclass
class Estimate:
    table: str
    selectivity: float
    cardinality: float
    used_model: bool
    reason: str | None = None
    diagnostics: dict = field(default_factory=dict)


@dataclass
class Estimator:
    """Selectivities from a network: enumeration of all allowed token combinations while they are few, else progressive
    sampling, all draws of a request as one batch."""

    encoder: TableEncoder
    model: Made
    seed: int = 123
    samples: int = 8000
    enumeration_cap: int = 4096

    def configure(self, seed: int, samples: int | None = None) -> None:
        if samples is not None and samples <= 0:
            raise ValueError("the number of samples must be positive")
        self.seed, self.samples = seed, samples or self.samples

    def estimate(self, predicates: list[Predicate]) -> Estimate:
        if not predicates:
            return Estimate(self.encoder.table, 1.0, float(self.encoder.row_count), True, None, {"inference_mode": "full_table", "sample_count": 0, "estimator_seed": self.seed, "constrained_columns": {}})
        allowed = self.encoder.allowed(predicates)
        if enumeration_size(allowed) <= self.enumeration_cap:
            mode, masses, share = "enumeration", {}, self.enumerate(allowed)
        else:
            mode = "progressive_sampling"
            share, masses = self.sample(allowed)
        columns = {}
        for p in predicates:
            i = self.encoder.column_index(p.column)
            columns[p.column] = {"encoding_type": self.encoder.columns[i].encoding, **token_digest(allowed[i]), "allowed_token_count": len(allowed[i]), "domain_size": self.encoder.columns[i].domain_size, "accepted_probability_mass": masses.get(i)}
        notes = {"inference_mode": mode, "sample_count": self.samples if masses else 0, "estimator_seed": self.seed, "constrained_columns": columns}
        return Estimate(self.encoder.table, share, share * self.encoder.row_count, True, None, notes)

    def enumerate(self, allowed: dict[int, list[int]]) -> float:
        if any(not t for t in allowed.values()):
            return 0.0
        grid = np.meshgrid(*(np.array(allowed[i]) for i in range(len(self.model.domains))), indexing="ij")
        return float(self.model.joint(np.stack([g.ravel() for g in grid], axis=1)).sum())

    def sample(self, allowed: dict[int, list[int]]) -> tuple[float, dict[int, float]]:
        rng = np.random.default_rng(self.seed)
        tokens = np.zeros((self.samples, len(self.model.domains)), dtype=np.int64)
        weight, masses = np.ones(self.samples), {}
        for i in range(len(self.model.domains)):
            if not allowed[i]:
                return 0.0, masses | {i: 0.0}
            p = self.model.conditionals(tokens, i)[0][:, allowed[i]]
            mass = p.sum(axis=1)
            masses[i] = float(mass.mean())
            weight *= mass
            p = p / np.maximum(mass, 1e-300)[:, None]
            pick = (np.cumsum(p, axis=1) < rng.random(self.samples)[:, None]).sum(axis=1)
            tokens[:, i] = np.array(allowed[i])[np.minimum(pick, len(allowed[i]) - 1)]
        return float(weight.mean()), masses


def estimates(spark, estimator: Estimator, requests: dict[str, list[Predicate]], seeds: list[int] | None = None) -> DataFrame:
    """(query_id, seed, selectivity, cardinality, inference_mode) of many requests and seeds, inferred in parallel tasks to
    which the network is broadcast once."""
    shared = spark.sparkContext.broadcast(estimator)
    names = list(requests)
    predicates = spark.sparkContext.broadcast([requests[n] for n in names])
    todo = spark.range(len(names)).withColumn("seed", F.explode(F.array(*(F.lit(s).cast("bigint") for s in seeds or [estimator.seed]))))
    parts = min(max(len(names) * len(seeds or [1]) // 4, 1), spark.sparkContext.defaultParallelism * 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shared.value
        for pdf in batches:
            rows = []
            for n, s in zip(pdf["id"], pdf["seed"]):
                e = Estimator(base.encoder, base.model, int(s), base.samples, base.enumeration_cap).estimate(predicates.value[n])
                rows.append((names[n], int(s), e.selectivity, e.cardinality, e.diagnostics["inference_mode"]))
            yield pd.DataFrame(rows, columns=["query_id", "seed", "selectivity", "cardinality", "inference_mode"])

    return todo.repartition(parts).mapInPandas(run, "query_id string, seed bigint, selectivity double, cardinality double, inference_mode string")
