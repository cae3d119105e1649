"""Tables of a schema, and models for all of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.operators import density, encoding
from cardscope.session import at_once
from cardscope.sources import artifacts


def schema_tables(spark: SparkSession, schema: str) -> list[str]:
    """The qualified names of the tables of a catalog schema, or of the Parquet tables of a folder, in order; no views."""
    if "/" in schema:
        return [f"{Path(schema).name}.{p.stem}" for p in sorted(Path(schema).glob("*.parquet"))]
    return sorted(f"{schema}.{t.name}" for t in spark.catalog.listTables(schema) if t.tableType not in ("VIEW", "TEMPORARY"))


def resolve(names: list[str], table: str) -> str:
    """The one of these qualified names that a table, qualified or not, means."""
    found = [n for n in names if table in (n, n.rpartition(".")[2])]
    if len(found) != 1:
        raise KeyError(f"{table} means {'no table' if not found else ' and '.join(found)}")
    return found[0]


def kept(name: str, only: list[str] | None = None, skip: list[str] | None = None) -> bool:
    """Whether a table is among those asked for and not among those left out; names may be qualified or not."""
    bare = name.rpartition(".")[2]
    return (not only or name in only or bare in only) and not (skip and (name in skip or bare in skip))


def read(spark: SparkSession, schema: str, name: str) -> DataFrame:
    bare = name.rpartition(".")[2]
    return spark.read.parquet(f"{schema}/{bare}.parquet") if "/" in schema else spark.table(name)


def training_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The columns that can be encoded, and at most `limit` rows, the same ones every time: the smallest by a hash."""
    names = [c["column"] for c in encoding.column_table(df, "") if c["supported"]]
    rows = df.select(*names)
    return rows if limit is None else rows.orderBy(F.xxhash64(*names), *names).limit(limit)


def train_all(
    spark: SparkSession, schema: str, base: str | Path, only: list[str] | None = None, skip: list[str] | None = None, columns: dict[str, list[str]] | None = None, max_rows: int | None = None, **options,
) -> DataFrame:
    """Trains and saves a model of every kept table; (table, status, reason, rows, columns, skipped, epochs, best_epoch,
    validation_loss) of each. max_rows: train on so many rows of each table; estimates are still of all of its rows. A table without a column that can be encoded, or without rows, is no error of the others."""
    names = [n for n in schema_tables(spark, schema) if kept(n, only, skip)]
    frames = {n: read(spark, schema, n) for n in names}
    encoders: dict[str, encoding.TableEncoder] = {}
    said: dict[str, tuple] = {}

    def fit(n: str) -> None:
        try:
            whole = frames[n].count() if max_rows is not None else None
            frames[n] = training_rows(frames[n], max_rows)
            e = encoding.TableEncoder.fit(frames[n], n.rpartition(".")[2], (columns or {}).get(n.rpartition(".")[2]), oversize="skip")
            if not e.row_count or not e.columns:
                raise ValueError("no rows" if not e.row_count else "no column that can be encoded")
            e.row_count = e.row_count if whole is None else whole
            encoders[n] = e
        except ValueError as x:
            said[n] = (n, "failed", str(x), None, None, None, None, None, None)

    at_once([lambda n=n: fit(n) for n in names])
    for n, (model, note) in density.train_many(spark, {n: (frames[n], e) for n, e in encoders.items()}, **options).items():
        e = encoders[n]
        summary = {"epochs": note.epochs, "best_epoch": note.best_epoch, "best_validation_loss": note.best_validation_loss, "stopped_early": note.stopped_early, "history": note.history}
        artifacts.save_model(base, n.rpartition(".")[0] or "default", n.rpartition(".")[2], model, e, summary=summary)
        said[n] = (n, "trained", None, e.row_count, [c.column for c in e.columns], sorted(e.skipped), note.epochs, note.best_epoch, note.best_validation_loss)
    schema_ = "table string, status string, reason string, rows bigint, columns array<string>, skipped array<string>, epochs int, best_epoch int, validation_loss double"
    return spark.createDataFrame([said[n] for n in names], schema_)
