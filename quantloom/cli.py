"""Command line: list, scan, backtest, research."""

from __future__ import annotations

import argparse
import ast
import sys

from pyspark.sql import functions as F

from . import sources
from .config import COSTS, PRESETS, ResearchConfig, cost_model, from_preset
from .operators import market as context
from .operators import metrics
from .operators.backtest import Settings, simulate, trades
from .plans import report
from .plans.research import Research
from .plans.strategies import STRATEGIES, strategy
from .plans.validation import dated
from .session import session

WARM_UP = 260


def literal(text: str) -> tuple[str, object]:
    """name=value; a value that is no literal is a string."""
    name, _, value = text.partition("=")
    try:
        return name, ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return name, value


def config(args: argparse.Namespace) -> ResearchConfig:
    given = {k: getattr(args, k, None) for k in ("benchmark", "start", "end", "source", "csv_dir", "cost_preset", "capital", "execution", "max_grid", "top_n", "seed", "output_dir")}
    given["universe"] = args.universe.split(",") if args.universe else None
    given["strategies"] = args.strategies.split(",") if getattr(args, "strategies", None) else None
    if getattr(args, "no_iterate", False):
        given["iterate"] = False
    if args.preset:
        return from_preset(args.preset, **given)
    if not args.universe or not args.benchmark:
        raise SystemExit("either a preset, or a universe and a benchmark")
    return ResearchConfig(name="custom", **{k: v for k, v in given.items() if v is not None})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quantloom")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="strategies, presets and costs")
    for name in ("scan", "backtest", "research"):
        p = commands.add_parser(name)
        for option in ("preset", "universe", "benchmark", "start", "end", "source", "csv-dir", "cost-preset", "execution", "master"):
            p.add_argument(f"--{option}")
        p.add_argument("--capital", type=float)
        p.add_argument("--seed", type=int)
        if name == "backtest":
            p.add_argument("strategy")
            p.add_argument("--param", action="append", default=[], type=literal)
        if name == "research":
            p.add_argument("--strategies")
            p.add_argument("--max-grid", type=int)
            p.add_argument("--top-n", type=int)
            p.add_argument("--output-dir")
            p.add_argument("--no-iterate", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        for s in STRATEGIES.values():
            print(f"{s.name:20} {s.family:18} {len(s.combinations()):3} sets  {s.thesis}")
        print("presets:", ", ".join(PRESETS), "\ncosts:", *(f"\n  {c.describe()}" for c in COSTS.values()))
        return 0
    c = config(args)
    spark = session(args.master)
    if args.command == "research":
        print(report.write(Research(spark, c).run(), c.output_dir))
        return 0
    m = sources.load(spark, c)
    if args.command == "scan":
        facts = context.overview(m, c.periods_per_year).first().asDict()
        print(*(f"{k}: {v}" for k, v in facts.items()), *context.interpret(facts), sep="\n")
        context.scan(m, c.periods_per_year).orderBy(*[x for x in ("momentum_rank", "asset") if len(m.assets) > 1 or x == "asset"]).show(500, False)
        return 0
    s = strategy(args.strategy)
    sim = simulate(s.targets(m, [s.params(**dict(args.param))]), m, Settings(cost_model(c.cost_preset), c.execution, c.capital, c.risk_free_rate, c.periods_per_year))
    daily, by_asset = sim.daily.cache(), sim.by_asset.cache()
    rows = dated(daily, m.bench).filter(F.col("n") >= WARM_UP)
    for k, v in metrics.summary(rows, m.bench_returns(), c.periods_per_year, c.risk_free_rate, trades(by_asset, m.bench), daily, by_asset).first().asDict().items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
