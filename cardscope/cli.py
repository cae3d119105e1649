"""python -m cardscope.cli COMMAND: training, checks, evaluation and single queries over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from cardscope.plans import catalogue, data_queries, model_queries, reference_queries, treatment_queries
from cardscope.session import local_session
from cardscope.sources import artifacts

# The queries of each experiment, in order.
EXPERIMENTS = {
    "accuracy": ("single_table_errors", "single_table_sections", "live_accuracy"), "failures": ("failure_categories", "worst_queries", "seed_sensitivity"), "influence": ("live_influence",),
    "quality": ("live_join_outputs", "live_join_quality"), "runtime": ("timed_summary",),
}


def _queries() -> dict:
    return {n: q for m in (reference_queries, model_queries, treatment_queries, data_queries) for n, q in m.queries().items()}


def _names(text: str | None) -> list[str] | None:
    return [n.strip() for n in text.split(",") if n.strip()] if text else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cardscope")
    p.add_argument("--cpus", type=int, default=4)
    p.add_argument("--log", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="a model of every table")
    t.add_argument("data"), t.add_argument("models"), t.add_argument("--only"), t.add_argument("--skip"), t.add_argument("--epochs", type=int, default=20), t.add_argument("--hidden", default="64,64")
    c = sub.add_parser("preflight", help="what has to hold before a run")
    c.add_argument("data")
    q = sub.add_parser("query", help="one query, as a folder of CSV or to the screen")
    q.add_argument("name"), q.add_argument("data"), q.add_argument("--out"), q.add_argument("--kind", default="csv", choices=("csv", "json", "parquet"))
    sub.add_parser("list", help="the names of all queries")
    r = sub.add_parser("run", help="all experiments, after the checks")
    r.add_argument("data"), r.add_argument("base"), r.add_argument("run_id"), r.add_argument("--resume", action="store_true"), r.add_argument("--overwrite", action="store_true"), r.add_argument("--only")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    if a.command == "list":
        print("\n".join(_queries()))
        return 0
    spark = local_session(a.cpus)
    if a.command == "train":
        hidden = tuple(int(n) for n in a.hidden.split(","))
        rows = catalogue.train_all(spark, a.data, a.models, _names(a.only), _names(a.skip), epochs=a.epochs, hidden=hidden)
        rows.show(100, False)
        return int(rows.where("status <> 'trained'").count() > 0)
    if a.command == "preflight":
        rows = treatment_queries.preflight_checks(spark, a.data)
        rows.show(100, False)
        return int(rows.where("not ok").count() > 0)
    if a.command == "query":
        df = _queries()[a.name](spark, a.data)
        if a.out:
            artifacts.write_table(df, a.out, df.columns, a.kind)
        else:
            df.show(50, False)
        return 0
    run = artifacts.RunContext.create(a.base, a.run_id, a.resume, a.overwrite)
    run.write_manifest(sys.argv[1:] if argv is None else argv)
    if treatment_queries.preflight_checks(spark, a.data).where("not ok").count():
        print("the checks before the run failed", file=sys.stderr)
        return 1
    for name in _names(a.only) or EXPERIMENTS:
        for query in EXPERIMENTS[name]:
            out = Path(run.folder(name)) / query
            if not (a.resume and (out / "_SUCCESS").exists()):
                _queries()[query](spark, a.data).write.mode("overwrite").json(str(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
