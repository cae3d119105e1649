"""Mixing sources to target shares of tokens, repeating documents at most a capped number of times.

A source that has to give f times its tokens gives floor(f) whole copies of every document; what is left of its tokens comes
from Pareto order sampling: each document draws odds u / (1 - u) from a hash of its id, divides them by its inclusion odds
and the smallest quotients are taken, until the tokens are there. With weights, inclusion probabilities differ by document and
documents with a high weight have their certain copies taken out first.

Order sampling needs no sort of a source: quotients are mapped to (0, 1), tokens are summed in BUCKETS equal parts of that range,
the part in which the budget ends is found from the sums, and only the documents of that one part are ordered.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 1 << 16
#: The targets are read to the driver; a larger table is refused.
MAX_SOURCES = 10_000

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a file of ranks, loaded once per process."""
    if path not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines())}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def with_tokens(df: DataFrame, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """df with its text replaced by `tokens`, the number of its tokens; a null or empty text has none."""
    kept = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        for batch in batches:
            counts = [len(bpe.encode_ordinary(t.as_py() or "")) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], [*kept, "tokens"])

    return df.select(*kept, text_col).mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """Names that differ in case, hyphens and blanks around them only are one source."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out: dict[str, tuple[float, int]] = {}
    for s, share, repeats in rows:
        before = out.get(s, (0.0, repeats if repeats is not None else 1))
        out[s] = (before[0] + max(share or 0.0, 0.0), max(min(before[1], repeats if repeats is not None else 1), 0))
    return out


def _by_source(values: dict[str, float], kind: str) -> Column:
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))]
    return F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast(kind)


def total_in_reach(targets: dict[str, tuple[float, int]], available: dict[str, int], least: float) -> float:
    """The largest total at which every source that has documents gets its share within its repeats, but at least that part
    of the tokens of all listed sources: a tiny source falls short rather than shrinking the mixture to nothing."""
    reach = [available[s] * r / w for s, (w, r) in targets.items() if w > 0 and available.get(s, 0) > 0 and r > 0]
    return max(min(reach), least * sum(available.values())) if reach else 0.0


def _capped_rates(rows: DataFrame, least: dict[str, float], cap: dict[str, int], need: dict[str, float], steps: int = 64, rounds: int = 4) -> dict[str, float]:
    """For each source the rate c at which sum(min(c * weight, cap) * tokens) is what it has to give. Caps only take away, so
    c is at least `least`; each round sums over `steps` rates between the known bounds in one pass."""
    found = rows.groupBy("source").agg(F.min("weight").alias("w")).collect()
    bounds = {r["source"]: (least[r["source"]], max(least[r["source"]], cap[r["source"]] / r["w"])) for r in found}
    for _ in range(rounds):
        grid = {s: [lo * (hi / lo) ** (k / (steps - 1)) if lo > 0 else 0.0 for k in range(steps)] for s, (lo, hi) in bounds.items()}
        at = [_by_source({s: g[k] for s, g in grid.items()}, "double") for k in range(steps)]
        got = rows.groupBy("source").agg(*(F.sum(F.least(c * F.col("weight"), _by_source(cap, "double")) * F.col("tokens")).alias(f"s{k}") for k, c in enumerate(at))).collect()
        for r in got:
            s = r["source"]
            above = next((k for k in range(steps) if r[f"s{k}"] >= need[s] * (1 - 1e-12)), steps - 1)
            bounds[s] = (grid[s][max(above - 1, 0)], grid[s][above])
    return {s: hi for s, (_, hi) in bounds.items()} if bounds else least


def mixture(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
    total_tokens: float | None = None, least: float = 0.5, seed: int = 1, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, tokens, copies), and per listed source the share it reached.

    targets: source, target_share, max_repeats. Shares are of tokens; a null or negative share is 0, a null cap 1; source rows
    named alike add their shares and keep the smaller cap. A document is used copies times, never more than the cap of its
    source. Without total_tokens the total is `total_in_reach`. A source that cannot give its share gives every document as
    often as allowed, and the report says so; the other sources keep their number of tokens. A source's tokens miss the target
    by at most half a document. Documents without tokens, with a null source or one that is not listed are not used. Equal
    weights (also null or non-positive ones count as the smallest, 1e-9) give every document of a source the same chance.
    Ids should be unique; rows with equal ids share their luck. Equal seeds give equal mixtures.
    """
    wanted = _targets(targets)
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1e-9)), F.lit(1e-9)) if weight_col else F.lit(1.0)
    named = documents.select(F.col(id_col).alias("id"), source_name(F.col(source_col)).alias("source"), weight.alias("weight"), F.col(text_col).alias("text"))
    rows = named.where(F.col("source").isin(list(wanted)) & F.col("text").isNotNull()) if wanted else named.where("false")
    rows = cut_lineage(with_tokens(rows, "text", tokenizer).where("tokens > 0"))
    sums = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum(F.col("tokens") * F.col("weight")).alias("wt")).collect()}
    available = {s: int(r["t"]) for s, r in sums.items()}
    total = total_in_reach(wanted, available, least) if total_tokens is None else float(total_tokens)
    need = {s: min(w * total, float(available.get(s, 0)) * r) for s, (w, r) in wanted.items()}

    # expected copies by document; their whole part is certain, their fraction the inclusion probability of one more
    cap = {s: wanted[s][1] for s in sums}
    rate = {s: need[s] / sums[s]["wt"] for s in sums}
    if weight_col:
        rate = _capped_rates(rows, rate, cap, need)
    expected = F.least(_by_source(rate, "double") * F.col("weight"), _by_source(cap, "double"))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-12).cast("int"))
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) * 2.0**-53
    p = F.greatest(F.col("expected") - F.col("whole"), F.lit(1e-12))
    quotient = (u / (1 - u)) / (p / (1 - p))
    rows = rows.withColumn("place", F.when(F.col("whole") < _by_source(cap, "int"), quotient / (1 + quotient)))
    part = F.when(F.col("place").isNotNull(), F.least(F.floor(F.col("place") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.withColumn("part", part).drop("expected", "weight")

    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("certain"))
    parts = rows.where("part is not null").groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    upto = F.sum("in_part").over(Window.partitionBy("source").orderBy("part"))  # at most BUCKETS rows a source
    ends = parts.withColumn("before", upto - F.col("in_part")).join(F.broadcast(certain), "source")
    ends = ends.withColumn("left", _by_source(need, "double") - F.col("certain") - F.col("before"))
    last = {r["source"]: (r["part"], r["left"]) for r in ends.where("left > 0").groupBy("source").agg(F.max_by(F.struct("part", "left"), "part").alias("e")).select("source", "e.*").collect()}
    border, left = _by_source({s: e[0] for s, e in last.items()}, "int"), _by_source({s: e[1] for s, e in last.items()}, "double")
    inside = rows.where(F.col("part") == border).withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = inside.withColumn("more", (F.col("run") - F.col("tokens") / 2 <= left).cast("int")).drop("run")
    others = rows.where((F.col("part") != border) | F.col("part").isNull() | border.isNull()).withColumn("more", F.coalesce((F.col("part") < border).cast("int"), F.lit(0)))
    chosen = others.unionByName(taken).select(F.col("id").alias(id_col), "source", "tokens", (F.col("whole") + F.col("more")).alias("copies")).where("copies > 0")
    chosen = cut_lineage(chosen)
    return chosen, _report(chosen, wanted, sums, need, total)


def _report(chosen: DataFrame, wanted: dict, sums: dict, need: dict, total: float) -> DataFrame:
    schema = "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, wanted_tokens double, in_reach boolean"
    facts = [(s, float(w), int(r), int(sums[s]["n"]) if s in sums else 0, int(sums[s]["t"]) if s in sums else 0, w * total, math.isclose(need[s], w * total, rel_tol=1e-9)) for s, (w, r) in wanted.items()]
    mixed = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    spark = chosen.sparkSession
    out = spark.createDataFrame(facts, schema).join(F.broadcast(mixed), "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    whole = mixed.agg(F.sum("mixed_tokens").alias("whole"))
    return out.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", "whole"), F.lit(0.0))).drop("whole")


