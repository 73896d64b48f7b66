"""A plain day-by-day simulator, for comparison only."""

import math


def simulate(target, close, open_, volume, costs, execution, capital=1e6, rf=0.0, periods=252):
    """Lists of rows by session; returns rows of (ret, gross, cost, turnover, participation)."""
    days, assets = range(len(close)), range(len(close[0]))
    ok = lambda x: x is not None
    leg = lambda a, b: a / b - 1 if ok(a) and ok(b) and b else 0.0
    prior = lambda t, i: close[t - 1][i] if t else None
    cc = [[leg(close[t][i], prior(t, i)) for i in assets] for t in days]
    on = [[leg(open_[t][i], prior(t, i)) for i in assets] for t in days]
    intra = [[leg(close[t][i], open_[t][i]) for i in assets] for t in days]
    want = [[target[t][i] if ok(close[t][i]) and ok(target[t][i]) else 0.0 for i in assets] for t in days]
    changed = [any(abs(want[t][i] - (want[t - 1][i] if t else 0.0)) > (1e-12 if t else 0.0) for i in assets) for t in days]

    def sd(t, i):
        x = [cc[u][i] for u in range(max(0, t - 21), t)]
        if len(x) < 10:
            return 0.02
        m = sum(x) / len(x)
        return math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1))

    def adv(t, i):
        x = [close[u][i] * (volume[u][i] or 0.0) for u in range(max(0, t - 20), t) if ok(close[u][i])]
        return sum(x) / len(x) if len(x) >= 5 else None

    w, equity, out = [0.0] * len(close[0]), 1.0, []
    for t in days:
        cost = turn = part = 0.0

        def fill(goal, t=t):
            nonlocal w, cost, turn, part
            for i in assets:
                d = goal[i] - w[i]
                cost += d * costs.buy_rate if d > 0 else -d * costs.sell_rate
                turn += abs(d)
                a = adv(t, i)
                if a:
                    share = abs(d) * equity * capital / a
                    part = max(part, share)
                    cost += abs(d) * costs.impact_coef * sd(t, i) * math.sqrt(share)
            w = list(goal)

        def drift(r):
            nonlocal w
            g = sum(x * y for x, y in zip(w, r, strict=True))
            w = [x * (1 + y) / (1 + g) for x, y in zip(w, r, strict=True)]
            return g

        if t == 0:
            if execution == "same_close" and changed[0]:
                fill(want[0])
            out.append((-cost, 0.0, cost, turn, part))
            equity *= 1 - cost
            continue
        g1 = g2 = 0.0
        if execution == "next_open":
            g1 = drift(on[t])
            if changed[t - 1]:
                fill(want[t - 1])
            g2 = drift(intra[t])
        else:
            g1 = drift(cc[t])
            if changed[t - 1] if execution == "next_close" else changed[t]:
                fill(want[t - 1] if execution == "next_close" else want[t])
        before = (1 + g1) * (1 - cost) * (1 + g2)
        cash = 1 - sum(w)
        carry = cash * (
            rf / periods if cash >= 0 else (rf + costs.financing_spread_bps / 1e4) / periods
        ) - costs.borrow_bps / 1e4 / periods * sum(max(0.0, -x) for x in w)
        growth = before * (1 + carry)
        out.append((growth - 1, before / (1 - cost) - 1, cost, turn, part))
        equity *= growth
    return out
