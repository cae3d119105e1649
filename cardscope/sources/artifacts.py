"""Files beside the data: strict JSON and CSV reports, model artifacts and their registry, run folders and manifests."""

from __future__ import annotations

import csv
import json
import math
import platform
import re
import subprocess
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.operators.density import Estimate, Estimator, Made
from cardscope.operators.encoding import Predicate, TableEncoder

VERSION = 1


def write_json(path: str | Path, value: object) -> Path:
    """Indented, with sorted keys; NaN and infinity are an error."""
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False, default=str)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text + "\n", encoding="utf-8")
    return path


def write_text(path: str | Path, text: str) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text.rstrip("\n") + "\n", encoding="utf-8")
    return path


def write_plan(path: str | Path, document: str) -> Path:
    """An EXPLAIN document, indented; one that is not complete JSON is an error."""
    return write_text(path, json.dumps(json.loads(document), indent=2))


def write_sql(path: str | Path, sql: str) -> Path:
    """A statement with one closing semicolon."""
    return write_text(path, sql.strip().rstrip("; \n") + ";")


def finite_only(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with these columns; a floating value that is NaN or infinite is an error, named by its column."""
    out = []
    for f in fields:
        c = F.col(f)
        if dict(df.dtypes)[f] in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f} is not finite")).cast(dict(df.dtypes)[f])).otherwise(c)
        out.append(c.alias(f))
    return df.select(*out)


def write_table(df: DataFrame, path: str, fields: list[str], kind: str = "csv") -> None:
    """A report of any size, as a folder written by all tasks: a fixed field list, other columns ignored, finite numbers only.
    In CSV, nested values are JSON text."""
    rows = finite_only(df, fields)
    if kind == "csv":
        nested = [f for f, t in rows.dtypes if t.startswith(("array", "map", "struct"))]
        rows.withColumns({f: F.to_json(f) for f in nested}).write.mode("overwrite").csv(path, header=True)
    else:
        getattr(rows.write.mode("overwrite"), kind)(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, maxCharsPerColumn=-1)


def write_failures(path: str | Path, failures: list[dict]) -> Path | None:
    """label, stage, reason, sql, then all other keys in order; no file without failures."""
    if not failures:
        return None
    fields = ["label", "stage", "reason", "sql"]
    fields += sorted({k for f in failures for k in f} - set(fields))
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as out:
        w = csv.DictWriter(out, fields)
        w.writeheader()
        w.writerows(failures)
    return path


def write_diagnostics(rows: DataFrame, path: str, key: str = "occurrence_id") -> DataFrame:
    """rows with `diagnostics_path`: a folder of JSON for each row, below path, by its key; written by all tasks. For reports of
    bounded size, as the worst queries."""
    safe = F.regexp_replace(F.coalesce(F.col(key).cast("string"), F.lit("none")), r"[^0-9A-Za-z._-]", "_")
    named = rows.withColumn("__folder", safe)
    named.write.mode("overwrite").partitionBy("__folder").json(path)
    return named.withColumn("diagnostics_path", F.concat(F.lit(f"{path}/__folder="), "__folder")).drop("__folder")


def template_map(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "template string, label string, query_id string")


FILES = ("model.npz", "encoders.json", "config.json", "metadata.json")


def save_model(base: str | Path, schema: str, table: str, model: Made, encoder: TableEncoder, config: dict | None = None, summary: dict | None = None) -> Path:
    """base/schema/table with the network, its encoders, settings and metadata, and the training summary if there is one."""
    folder = Path(base) / schema / table
    folder.mkdir(parents=True, exist_ok=True)
    np.savez(folder / "model.npz", **model.params, **{f"mask{i}": m for i, m in enumerate(model.masks)})
    write_text(folder / "encoders.json", encoder.to_json())
    write_json(folder / "config.json", (config or {}) | {"domains": model.domains, "embedding": model.embedding, "hidden": list(model.hidden)})
    write_json(folder / "metadata.json", {"version": VERSION, "qualified_name": f"{schema}.{table}", "row_count": encoder.row_count, "columns": [c.column for c in encoder.columns]})
    if summary is not None:
        write_json(folder / "training_summary.json", summary)
    return folder


def load_model(folder: str | Path) -> tuple[Made, TableEncoder, dict]:
    """Network, encoder and settings; another version or other columns than the encoder's are an error."""
    folder = Path(folder)
    meta = json.loads((folder / "metadata.json").read_text())
    config = json.loads((folder / "config.json").read_text())
    encoder = TableEncoder.from_json((folder / "encoders.json").read_text())
    if meta.get("version") != VERSION:
        raise ValueError(f"{folder} has version {meta.get('version')}; {VERSION} is expected")
    if meta["columns"] != [c.column for c in encoder.columns]:
        raise ValueError(f"{folder}: the encoder has other columns than the model")
    model = Made(config["domains"], config["embedding"], tuple(config["hidden"]))
    with np.load(folder / "model.npz") as stored:
        model.params = {k: stored[k] for k in stored.files if not k.startswith("mask")}
        model.masks = [stored[f"mask{i}"] for i in range(len(model.masks))]
    return model, encoder, config


@dataclass
class Registry:
    """The complete models below a folder, by qualified name; loaded when first asked, estimates remembered."""

    base: Path
    folders: dict[str, Path] = field(default_factory=dict)
    seed: int = 123
    samples: int = 8000
    _loaded: dict[str, Estimator] = field(default_factory=dict)
    _known: dict[tuple, Estimate] = field(default_factory=dict)

    @classmethod
    def load(cls, base: str | Path, required: bool = False, **options) -> Registry:
        """Folders that are incomplete or whose metadata cannot be read are passed over; with required, no model at all is an error."""
        out = cls(Path(base), **options)
        for meta in sorted(out.base.glob("*/*/metadata.json")) if out.base.is_dir() else []:
            try:
                name = json.loads(meta.read_text())["qualified_name"]
            except (ValueError, KeyError, TypeError):
                continue
            if all((meta.parent / f).exists() for f in FILES):
                out.folders[name] = meta.parent
        if required and not out.folders:
            raise FileNotFoundError(f"no model below {out.base}")
        return out

    @property
    def tables(self) -> list[str]:
        return sorted(self.folders)

    def resolve(self, table: str, schema: str | None = None) -> str:
        """The qualified name: as given, with the default schema, or the only model of that bare name."""
        if "." in table:
            return table
        if schema:
            return f"{schema}.{table}"
        found = [n for n in self.folders if n.partition(".")[2] == table]
        if len(found) > 1:
            raise KeyError(f"{table} has models in {', '.join(sorted(found))}; name the schema")
        if not found:
            raise KeyError(f"{table} has no model below {self.base}")
        return found[0]

    def has_model(self, table: str, schema: str | None = None) -> bool:
        try:
            return self.resolve(table, schema) in self.folders
        except KeyError:
            return False

    def estimator(self, table: str, schema: str | None = None) -> Estimator:
        name = self.resolve(table, schema)
        if name not in self._loaded:
            model, encoder, config = load_model(self.folders[name])
            self._loaded[name] = Estimator(encoder, model, self.seed, self.samples, config.get("enumeration_cap", 4096))
        return self._loaded[name]

    def configure(self, seed: int, samples: int | None = None) -> None:
        self.seed, self.samples = seed, samples or self.samples
        self._known.clear()
        for e in self._loaded.values():
            e.configure(seed, samples)

    def estimate(self, table: str, predicates: list[Predicate], schema: str | None = None) -> Estimate:
        key = (self.resolve(table, schema), self.seed, self.samples, tuple(map(repr, predicates)))
        if key not in self._known:
            self._known[key] = self.estimator(table, schema).estimate(predicates)
        return self._known[key]


def estimate_request(registry: Registry, graph, aliases: list[str] | str, native, schema: str | None = None) -> Estimate:
    """The model's estimate of one relation of a statement, else the native one with the reason: several relations, a filter
    that cannot be translated, no model, or an error of the model. native: function of the aliases asked for."""
    predicates, reason = graph.translate(aliases)
    names = [aliases] if isinstance(aliases, str) else list(aliases)
    table = next((r.table for r in graph.relations if r.alias == names[0]), None) if len(names) == 1 else None
    if reason is None and table is None:
        reason = "request is not single-table"
    if reason is None:
        try:
            return registry.estimate(table, predicates, schema)
        except (KeyError, ValueError) as x:
            reason = str(x.args[0] if x.args else x)
    return Estimate(table or "", 0.0, float(native(names)), False, reason)


@dataclass
class RunContext:
    """The folder of one run; an existing one must be resumed or overwritten by intent."""

    root: Path

    @classmethod
    def create(cls, base: str | Path, run_id: str, resume: bool = False, overwrite: bool = False) -> RunContext:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
            raise ValueError("a run id consists of letters, digits, dots, dashes and underscores")
        root = Path(base) / run_id
        if root.exists() and not (resume or overwrite):
            raise FileExistsError(f"{root} exists: resume or overwrite it")
        root.mkdir(parents=True, exist_ok=True)
        return cls(root)

    def folder(self, experiment: str) -> Path:
        out = self.root / experiment
        out.mkdir(parents=True, exist_ok=True)
        return out

    def write_manifest(self, argv: list[str], tables: dict[str, int] | None = None) -> Path:
        """Arguments with secrets blanked, versions, commit and table sizes; an older manifest keeps its start."""
        path = self.root / "manifest.json"
        old = json.loads(path.read_text()) if path.exists() else {}
        now = datetime.now(timezone.utc).isoformat()
        return write_json(path, {
            "run_id": self.root.name, "started": old.get("started", now), "updated": now, "argv": redacted(argv), "python": platform.python_version(),
            "pyspark": pyspark.__version__, "git": _git(), "tables": tables or old.get("tables", {}),
        })


def redacted(argv: list[str]) -> list[str]:
    """Values of arguments that hold a connection or secret, after = or as the next argument, become ***."""
    out, hide = [], False
    for a in argv:
        secret = re.match(r"(--[\w-]*(?:connect|password|secret|token|dsn)[\w-]*)(=)?", a)
        out.append("***" if hide else f"{secret[1]}=***" if secret and secret[2] else a)
        hide = bool(secret and not secret[2])
    return out


def _git() -> dict:
    try:
        run = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        return {"commit": run("rev-parse", "HEAD"), "dirty": bool(run("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return {"commit": None, "dirty": None}


def json_safe(v: object) -> object:
    """Numbers that are not finite become null, unknown objects text."""
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [json_safe(x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)
