"""Sinks of a run: tables as CSV, a summary as JSON, a report in Markdown, and charts where matplotlib is installed."""

from __future__ import annotations

import dataclasses
import json
import math
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from ..config import cost_model
from ..operators import market as context
from ..operators import metrics
from .research import Result

MARKS = {True: "yes", False: "no", None: "n/a"}


def percent(x, digits: int = 1) -> str:
    return "n/a" if x is None or x != x or math.isinf(x) else f"{x:.{digits}%}"


def plain(x, digits: int = 2) -> str:
    return "n/a" if x is None or x != x or math.isinf(x) else f"{x:.{digits}f}"


def table(rows: list[dict]) -> str:
    if not rows:
        return "_none_\n"
    head = list(rows[0])
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *(line(r.values()) for r in rows)]) + "\n"


def chart_data(r: Result) -> dict[str, pd.DataFrame]:
    """What each chart shows, small enough for the driver: one row a session and line, or a row a cell."""
    if r.returns is None:
        return {}
    top = r.ranking.strategy.head(5).tolist()
    falls = metrics.drawdowns(r.returns.filter(F.col("config_id").isin(top)))
    lines = falls.select("config_id", "date", "equity", "dd").orderBy("date").toPandas()
    return {
        "equity": lines.pivot(index="date", columns="config_id", values="equity"),
        "drawdown": lines.pivot(index="date", columns="config_id", values="dd"),
        "sharpe": r.ranking[["strategy", "wf_sharpe", "benchmark_sharpe"]],
        "sensitivity": pd.concat([v["sensitivity"].toPandas().assign(strategy=k) for k, v in r.strategies.items()], ignore_index=True),
        "yearly": metrics.yearly(r.returns).toPandas().pivot(index="year", columns="config_id", values="r"),
        "correlation": context.correlations(r.returns.select("n", F.col("config_id").alias("asset"), "r")).toPandas(),
        "regimes": pd.concat([v["regime_table"] for v in r.strategies.values()], ignore_index=True),
    }


def save_tables(r: Result, folder: Path, data: dict[str, pd.DataFrame]) -> None:
    out = folder / "results"
    out.mkdir(parents=True, exist_ok=True)
    r.ranking.to_csv(out / "ranking.csv", index=False)
    pd.DataFrame({k: v["wf"] for k, v in r.strategies.items()}).T.to_csv(out / "walk_forward_metrics.csv", index_label="strategy")
    if r.returns is not None:
        r.returns.orderBy("date").toPandas().pivot(index="date", columns="config_id", values="r").to_csv(out / "walk_forward_returns.csv")
    for k, v in data.get("sensitivity", pd.DataFrame(columns=["strategy"])).groupby("strategy"):
        v.to_csv(out / f"sensitivity_{k.replace('+', '_')}.csv", index=False)
    if len(r.scan):
        r.scan.to_csv(out / "opportunity_scan.csv", index=False)
    costs = cost_model(r.config.cost_preset)
    facts = {
        "config": dataclasses.asdict(r.config),
        "costs": dataclasses.asdict(costs) | {"text": costs.describe()},
        "period": [r.windows["start"], r.market.sessions()[-1]],
        "n_trials": r.n_trials,
        "sr_std": r.sr_std,
        "selected": r.selected,
        "ranking": r.ranking.to_dict("records"),
    }
    (out / "summary.json").write_text(json.dumps(facts, default=str, indent=1))


def _header(r: Result) -> str:
    days = r.market.sessions()
    rows = [
        {"": k, " ": v} for k, v in (
            ("Universe", ", ".join(r.market.assets)),
            ("Benchmark", r.market.benchmark),
            ("Source", r.market.source),
            ("Sessions", f"{len(days)}, {days[0]} to {days[-1]}"),
            ("Trials", r.n_trials),
            ("Walk-forward", f"{len(r.windows['wf'])} windows, {r.windows['train_years']} years of training, {r.windows['test_years']} of test"),
            ("Seconds", f"{r.seconds:.0f}"),
        )
    ]
    return f"# Research: {r.config.name}\n\n{table(rows)}\n" + "".join(f"> {n}\n>\n" for n in r.notes)


def _summary(r: Result) -> str:
    count = r.ranking.status.value_counts().to_dict()
    b = r.benchmark["wf"]
    lines = [
        f"{count.get('VALIDATED', 0)} validated, {count.get('PROMISING', 0)} promising, {count.get('REJECTED', 0)} rejected.",
        f"The benchmark grew by {percent(b['cagr'])} a year at a Sharpe ratio of {plain(b['sharpe'])}, and fell by {percent(b['max_drawdown'])} at most.",
    ]
    if r.blend:
        m = r.blend["metrics"]
        lines.append(
            f"A blend of {', '.join(r.selected)}: {percent(m['cagr'])} a year, Sharpe ratio {plain(m['sharpe'])}, largest fall {percent(m['max_drawdown'])}."
        )
    elif not r.selected:
        lines.append("No strategy is good enough to be chosen.")
    return "## 1. Summary\n\n" + "\n".join(f"- {x}" for x in lines) + "\n"


def _market(r: Result) -> str:
    facts = [{"Fact": k.replace("_", " "), "Value": plain(v, 3) if isinstance(v, float) else v} for k, v in r.overview["facts"].items()]
    scan = [
        {
            k: plain(v) if isinstance(v, float) else v for k, v in row.items()
        } for row in r.scan.sort_values([c for c in ("momentum_rank", "asset") if c in r.scan]).to_dict("records")
    ]
    macro = "" if r.macro is None else "\n### Macro series\n\n" + table(r.macro.to_dict("records"))
    quality = [] if r.market.quality is None else [x.asDict() for x in r.market.quality.collect()]
    return "## 3. Market\n\n" + table(facts) + "\n" + "\n".join(
        f"- {s}" for s in r.overview["interpretation"]
    ) + "\n\n### Scan\n\n" + table(scan) + macro + "\n### Data quality\n\n" + table(quality)


def _ranking(r: Result) -> str:
    rows = [
        {
            "Rank": x["rank"],
            "Strategy": x["strategy"],
            "Status": x["status"],
            "Score": x["score"],
            "Sharpe": plain(x["wf_sharpe"]),
            "Growth": percent(x["wf_cagr"]),
            "Largest fall": percent(x["wf_max_dd"]),
            "Deflated": plain(x["dsr"]),
            "Robust": plain(x["robustness"]),
            "Turnover": plain(x["annual_turnover"], 1),
            "Issue": x["main_issue"],
        } for x in r.ranking.to_dict("records")
    ]
    rest = "".join(f"- {k}: {v}\n" for k, v in [*r.left_out.items(), *r.skipped])
    return "## 4. Ranking\n\n" + table(rows) + ("\nLeft out:\n\n" + rest if rest else "")


def _strategy(name: str, v: dict) -> str:
    d, verdict = v["strategy_def"], v["verdict"]
    checks = [{"Check": c.name, "Value": c.value, "Wanted": c.wanted, "Passed": MARKS[c.passed], "Kind": c.kind} for c in verdict.checks]
    samples = [
        {
            "Sample": s,
            "Sharpe": plain(m.get("sharpe")),
            "Growth": percent(m.get("cagr")),
            "Largest fall": percent(m.get("max_drawdown")),
            "Trades": m.get("n_trades", "n/a"),
        } for s, m in (("in", v["is"]), ("out", v["oos"]), ("walk-forward", v["wf"]))
    ]
    windows = [
        {
            "Test": f"{w['test_start']} to {w['test_end']}",
            "Parameters": w["label"],
            "Training": plain(w["train_sharpe"]),
            "Result": plain(w["test_sharpe"]),
        } for w in v["windows"]
    ]
    numbers = lambda frame: [
        {k: plain(x) if isinstance(x, float) else x for k, x in row.items() if k != "config_id"} for row in frame.to_dict("records")
    ]
    parts = [
        f"### {name}: {verdict.status}, {verdict.score}",
        d.thesis,
        d.rules,
        f"Parameters now: {', '.join(f'{k}={x}' for k, x in v['deployed'].items())}. Sharpe ratio with 95 % confidence: {plain(v['ci'][0])} to {plain(v['ci'][1])}; t = {plain(v['t_stat'])}.",
        table(checks),
        table(samples),
        table([{"Scenario": k, "Sharpe": plain(x)} for k, x in v["stress"].items()]),
        table(windows),
        table(numbers(v["regime_table"])),
        table(numbers(v["crises"])),
        table(numbers(v["pnl"])),
        table([{"Without": k, "Sharpe": plain(x)} for k, x in v["without"].items()]),
    ]
    return "\n\n".join(parts)


def _advice(r: Result) -> str:
    rows = []
    for name in r.selected:
        v, c = r.strategies[name], r.config
        share = v["wf"].get("max_participation") or 0.0
        room = c.capital * c.criteria.max_adv_participation / share if share > 0 else math.nan
        rows.append(
            {
                "Strategy": name,
                "Capacity": plain(room, 0),
                "Stop at a fall of": percent(min(0.5, 1.5 * v["wf"]["max_drawdown"])),
                "Parameters": ", ".join(f"{k}={x}" for k, x in v["deployed"].items()),
            }
        )
    return "## 7. What to do\n\n" + table(rows) + "\nCapacity is where the largest trade would reach the allowed share of daily volume. The stop is one and a half times the largest fall of the walk-forward, half of the capital at most.\n"


def _risks(r: Result) -> str:
    return "## 8. Limits\n\n- Fills are modelled, not observed; daily bars hide what happens within a day.\n- Only prices and volumes are used.\n- Trying many rules finds luck: ratios are deflated for all trials, which helps but does not prove.\n- Past regimes may not return.\n"


def _findings(r: Result) -> str:
    """What holds over all strategies, in sentences."""
    wf = {k: v["wf"] for k, v in r.strategies.items()}
    known = {k: m["sharpe"] for k, m in wf.items() if m.get("sharpe") is not None}
    lines = []
    if known:
        best, worst = max(known, key=known.get), min(known, key=known.get)
        lines.append(f"Out of sample, {best} did best (Sharpe ratio {plain(known[best])}) and {worst} worst ({plain(known[worst])}).")
        ahead = sum(m["sharpe"] > (m.get("benchmark_sharpe") or 0.0) for m in wf.values() if m.get("sharpe") is not None)
        lines.append(f"{ahead} of {len(known)} had a higher ratio than the benchmark.")
    missed: dict[str, int] = {}
    for v in r.strategies.values():
        for name in v["verdict"].missed:
            missed[name] = missed.get(name, 0) + 1
    lines += [f"{n} failed on: {name}." for name, n in sorted(missed.items(), key=lambda x: (-x[1], x[0]))[:5]]
    lines.append(
        f"{r.n_trials} configurations were tried; by luck alone their best would be expected to look good, and ratios are deflated for that."
    )
    return "## 2. Findings\n\n" + "\n".join(f"- {x}" for x in lines) + "\n"


def _comparison(r: Result) -> str:
    """Walk-forward books beside the blend, buying and holding, and the benchmark."""
    books = {k: v["wf"] for k, v in r.strategies.items()}
    if r.blend:
        books["blend"] = r.blend["metrics"]
    books |= {"buy and hold": r.baseline, "benchmark": r.benchmark.get("wf", {})}
    kinds = (
        ("Growth", "cagr", percent),
        ("Volatility", "ann_vol", percent),
        ("Sharpe", "sharpe", plain),
        ("Sortino", "sortino", plain),
        ("Largest fall", "max_drawdown", percent),
        ("Positive years", "positive_years", percent),
        ("Beta", "beta", plain),
    )
    return "## 6. Comparison\n\n" + table([{"Book": k} | {title: show(m.get(c)) for title, c, show in kinds} for k, m in books.items()])


def _final_check(r: Result) -> str:
    """Whether the run itself can be trusted."""
    looks = {k: v["lookahead"]["passed"] for k, v in r.strategies.items()}
    flagged = [] if r.market.quality is None else [x.asset for x in r.market.quality.filter("status <> 'ok'").collect()]
    rows = [
        {"Question": "Does any rule look ahead?", "Answer": "no" if all(looks.values()) else ", ".join(k for k, ok in looks.items() if not ok)},
        {"Question": "Are results out of sample?", "Answer": f"yes, over {len(r.windows['wf'])} walk-forward windows"},
        {"Question": "Are costs in?", "Answer": cost_model(r.config.cost_preset).describe()},
        {"Question": "Is the number of trials accounted for?", "Answer": f"yes, {r.n_trials}"},
        {"Question": "Is the history long enough?", "Answer": "no, windows were shortened" if r.windows["short"] else "yes"},
        {"Question": "Are the data clean?", "Answer": "yes" if not flagged else f"see the quality flags of {', '.join(flagged)}"},
    ]
    return "## 9. Final check\n\n" + table(rows)


def _appendices(r: Result) -> str:
    settings = [{"Setting": k, "Value": v} for k, v in dataclasses.asdict(r.config).items() if k not in ("criteria", "notes")]
    limits = [{"Threshold": k, "Value": v} for k, v in dataclasses.asdict(r.config.criteria).items()]
    rules = [
        {
            "Strategy": k,
            "Family": v["strategy_def"].family,
            "Grid": "; ".join(f"{p}: {x}" for p, x in v["strategy_def"].grid.items()),
        } for k, v in r.strategies.items()
    ]
    again = f"python -m quantloom research --source {r.config.source} --universe {','.join(r.config.universe)} --benchmark {r.config.benchmark} --start {r.config.start}"
    return f"## Appendix A: settings\n\n{table(settings)}\n{table(limits)}\n## Appendix B: strategies and how to run this again\n\n{table(rules)}\n    {again}\n"


def markdown(r: Result) -> str:
    log = "## 10. Overlays tried\n\n" + ("".join(f"- {x}\n" for x in r.log) or "_none_\n")
    details = ["## 5. Strategies\n", *(_strategy(k, v) for k, v in r.strategies.items())]
    return "\n".join(
        [
            _header(r), _summary(r), _findings(r), _market(r), _ranking(r), *details, _comparison(r), _advice(r), _risks(r),
            _final_check(r), log, _appendices(r),
        ]
    )


def draw(data: dict[str, pd.DataFrame], folder: Path) -> list[str]:
    """Charts as PNG; none where matplotlib is missing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    folder.mkdir(parents=True, exist_ok=True)
    made = []
    for name, frame in data.items():
        fig, ax = pyplot.subplots(figsize=(9, 4))
        if name in ("equity", "drawdown"):
            frame.plot(ax=ax, logy=name == "equity")
        elif name == "sharpe":
            frame.set_index("strategy").plot.barh(ax=ax)
        elif name == "sensitivity":
            frame.plot.scatter("is_sharpe", "oos_sharpe", ax=ax)
        elif name == "regimes":
            frame.pivot_table(index="regime", columns="config_id", values="sharpe").plot.bar(ax=ax)
        else:
            grid = frame.pivot(index="a", columns="b", values="corr") if name == "correlation" else frame
            ax.imshow(grid.to_numpy(float))
            ax.set_xticks(range(grid.shape[1]), grid.columns, rotation=90)
            ax.set_yticks(range(grid.shape[0]), grid.index)
        ax.set_title(name)
        fig.savefig(folder / f"{name}.png", bbox_inches="tight")
        pyplot.close(fig)
        made.append(f"{name}.png")
    return made


def write(r: Result, folder: str) -> Path:
    """Everything to a folder; the report's path."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    data = chart_data(r)
    save_tables(r, out, data)
    charts = draw(data, out / "charts")
    path = out / "REPORT.md"
    path.write_text(markdown(r) + "".join(f"\n![{c}](charts/{c})\n" for c in charts))
    return path
