"""Estimators over a stretch of one symbol's rows in order of arrival, given what came before it.

Each estimator has three functions. `run(state, rows)` gives its fields for the rows of a stretch; `part(rows)` says
what a stretch leaves behind, without knowing what came before; `join(state, part)` is the state after it. So stretches are
summed up and run on their own, and only parts are joined in order. A state is a few numbers and the last rows that the
estimator's window needs. Everything is arrays of doubles; nan stands for null.

Columns of rows: day, ltp, ltq, volume, midprice, spread and the top of the book (bid, bid_qty, ask, ask_qty).
"""

from __future__ import annotations

import numpy as np

Rows = dict[str, np.ndarray]
NONE = np.zeros(0)


def last_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of the last `width` numbers at each place: what a block of `width` has so far, and the rest of the block before.

    Only sums of `width` numbers at most, no differences: rounding does not pile up along the series.
    """
    blocks = np.zeros((-(-len(x) // width), width))
    blocks.ravel()[: len(x)] = x
    out = np.cumsum(blocks, axis=1)
    out[1:, :-1] += np.cumsum(blocks[:-1, ::-1], axis=1)[:, ::-1][:, 1:]
    return out.ravel()[: len(x)]


def above(x: np.ndarray) -> np.ndarray:
    """Finite numbers above 0."""
    return (x > 0) & (x < np.inf)


def carried(change: np.ndarray, first: float) -> np.ndarray:
    """The last sign so far that is not 0; `first` before any."""
    at = np.maximum.accumulate(np.where(change != 0, np.arange(1, len(change) + 1), 0))
    return np.concatenate([[first], change])[at]


def spread_out(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(n, np.nan)
    out[at] = values
    return out


def counts(n: int, width: int) -> np.ndarray:
    """How many rows a window has at each place."""
    return np.minimum(np.arange(1, n + 1), width)


class Tail:
    """Rows that count, and those of them that a window needs from before; the last column is the sign of the last price change.

    In a part, signs before the first change are nan: join() sets them from the state and the first price.
    """

    def __init__(self, columns: int, keep: int, signed: bool):
        self.columns, self.keep, self.signed = columns, keep, signed

    def table(self, state: np.ndarray) -> np.ndarray:
        return state.reshape(-1, self.columns)

    def part(self, values: np.ndarray) -> np.ndarray:
        """values: rows without signs; the price is their second column. The first row's price goes ahead of the rows."""
        if not self.signed:
            return values[-self.keep :].ravel()
        if not len(values):
            return NONE
        change = np.sign(np.diff(values[:, 1], prepend=values[0, 1]))
        rows = np.column_stack([values, carried(change, np.nan)])[-self.keep :]
        return np.concatenate([[values[0, 1]], rows.ravel()])

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        if self.signed and len(part):
            first, part = part[0], part[1:].copy()
            if len(state):
                edge = np.sign(first - self.table(state)[-1, 1]) or state[-1]
            else:
                edge = 0.0
            signs = self.table(part)[:, -1]
            signs[np.isnan(signs)] = edge
        return np.concatenate([state, part])[-self.keep * self.columns :]

    def whole(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        """State and rows in one table, signs set."""
        old = self.table(state)
        if self.signed:
            prices = np.concatenate([old[-1:, 1], values[:, 1]])
            change = np.sign(np.diff(prices)) if len(old) else np.sign(np.diff(prices, prepend=prices[:1]))
            values = np.column_stack([values, carried(change, old[-1, -1] if len(old) else 0.0)])
        return np.concatenate([old, values])


class Kyle:
    """Slope of mid returns (bps) on signed trade sizes, its r² and t value."""

    fields = ("kyle_lambda", "kyle_r2", "kyle_t_stat")

    def __init__(self, window: int = 300, least: int = 30):
        self.window, self.least, self.tail = window, least, Tail(4, window + 1, True)

    def rows(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(above(r["midprice"]) & above(r["ltp"]) & ~np.isnan(r["ltq"]))
        return at, np.column_stack([r["midprice"][at], r["ltp"][at], r["ltq"][at]])

    def part(self, r: Rows) -> np.ndarray:
        return self.tail.part(self.rows(r)[1])

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return self.tail.join(state, part)

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at, own = self.rows(r)
        t = self.tail.whole(state, own)
        y = (t[1:, 0] - t[:-1, 0]) / t[:-1, 0] * 1e4
        x = t[1:, 3] * t[1:, 2]
        n, w = counts(len(x), self.window), self.window
        sx, sy, xx, xy, yy = (last_sums(v, w) for v in (x, y, x * x, x * y, y * y))
        sxx, sxy, syy = xx - sx * sx / n, xy - sx * sy / n, yy - sy * sy / n
        flat = sxx < 1e-12 * np.maximum(1.0, xx)
        slope = np.where(flat, 0.0, sxy / np.where(flat, 1.0, sxx))
        rest = np.maximum(0.0, syy - slope * sxy)
        none = flat | (syy <= 0)
        r2 = np.where(none, 0.0, np.maximum(0.0, 1 - rest / np.where(none, 1.0, syy)))
        mse = rest / np.maximum(n - 2, 1)
        none = flat | (mse <= 0)
        tv = np.where(none, 0.0, slope / np.sqrt(np.where(none, 1.0, mse / np.where(flat, 1.0, sxx))))
        return [_own(len(r["ltp"]), at, np.where(n >= self.least, v, np.nan)) for v in (slope, r2, tv)]


def _own(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last values, as many as `at` has places; where there are fewer (first rows without one before) the first are null."""
    values = np.concatenate([np.full(max(0, len(at) - len(values)), np.nan), values])
    return spread_out(n, at, values[len(values) - len(at) :])


class Amihud:
    """Mean of |mid return| over traded money, per million; the state is the last mid, then ratios."""

    fields = ("amihud_illiq",)

    def __init__(self, window: int = 300):
        self.window = window

    def rows(self, r: Rows, before: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and ratios of the rows with money, nan where no mid is before; the last mid."""
        at = np.flatnonzero(above(r["midprice"]) & above(r["ltp"]) & ~np.isnan(r["ltq"]))
        mid, money = r["midprice"][at], r["ltp"][at] * r["ltq"][at]
        prev = np.concatenate([[before], mid[:-1]])
        paid = money > 0
        ratio = np.abs(mid - prev)[paid] / prev[paid] * 1e4 / money[paid] * 1e6
        return at[paid], ratio, mid[-1] if len(mid) else np.nan

    def part(self, r: Rows) -> np.ndarray:
        """First mid and money, last mid, ratios."""
        at = np.flatnonzero(above(r["midprice"]) & above(r["ltp"]) & ~np.isnan(r["ltq"]))[:1]
        if not len(at):
            return NONE
        _, ratio, last = self.rows(r, np.nan)
        return np.concatenate([r["midprice"][at], r["ltp"][at] * r["ltq"][at], [last], ratio[~np.isnan(ratio)][-self.window :]])

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(part):
            return state
        mid, money, last, ratios = part[0], part[1], part[2], part[3:]
        first = [abs(mid - state[0]) / state[0] * 1e4 / money * 1e6] if len(state) and money > 0 else []
        return np.concatenate([[last], np.concatenate([state[1:], first, ratios])[-self.window :]])

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at, ratio, _ = self.rows(r, state[0] if len(state) else np.nan)
        at, ratio = at[~np.isnan(ratio)], ratio[~np.isnan(ratio)]
        whole = np.concatenate([state[1:], ratio])
        return [_own(len(r["ltp"]), at, last_sums(whole, self.window) / counts(len(whole), self.window))]


class Roll:
    """Serial covariance of price changes and the spread that it implies."""

    fields = ("roll_serial_cov", "roll_spread_bps")

    def __init__(self, window: int = 200, least: int = 30):
        self.window, self.least, self.tail = window, least, Tail(1, window + 2, False)

    def rows(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(above(r["ltp"]))
        return at, r["ltp"][at][:, None]

    def part(self, r: Rows) -> np.ndarray:
        return self.tail.part(self.rows(r)[1])

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return self.tail.join(state, part)

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at, own = self.rows(r)
        change = np.diff(self.tail.whole(state, own)[:, 0])
        x, y, w = change[1:], change[:-1], self.window
        n = counts(len(x), w)
        cov = last_sums(x * y, w) / n - last_sums(x, w) / n * last_sums(y, w) / n
        cov = _own(len(r["ltp"]), at, np.where(n >= self.least, cov, np.nan))
        mid = r["midprice"]
        there = (cov < 0) & (mid > 0)
        bps = np.where(there, 2 * np.sqrt(np.where(there, -cov, 0.0)) / np.where(there, mid, 1.0) * 1e4, 0.0)
        return [cov, np.where(np.isnan(cov), np.nan, bps)]


class Share:
    """Share of the trade prices' variance in that of trades and mids, and the mean signed trade return."""

    fields = ("trade_variance_share", "avg_signed_trade_return_bps")

    def __init__(self, window: int = 500, least: int = 50):
        self.window, self.least, self.tail = window, least, Tail(3, window + 1, True)

    def rows(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(above(r["midprice"]) & above(r["ltp"]))
        return at, np.column_stack([r["midprice"][at], r["ltp"][at]])

    def part(self, r: Rows) -> np.ndarray:
        return self.tail.part(self.rows(r)[1])

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return self.tail.join(state, part)

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at, own = self.rows(r)
        t = self.tail.whole(state, own)
        q, v = ((t[1:, c] - t[:-1, c]) / t[:-1, c] * 1e4 for c in (0, 1))
        n, w = counts(len(q), self.window), self.window
        var = lambda x: np.maximum(0.0, last_sums(x * x, w) / n - (last_sums(x, w) / n) ** 2)
        vt, vq = var(v), var(q)
        total = vt + vq
        share = np.where(total > 0, vt / np.where(total > 0, total, 1.0), 0.5)
        signed = last_sums(t[1:, 2] * v, w) / n
        return [_own(len(r["ltp"]), at, np.where(n >= self.least, x, np.nan)) for x in (share, signed)]


def score(past: np.ndarray, own: np.ndarray, window: int, least: int = 5) -> np.ndarray:
    """Own values against mean and population deviation of the `window` values before each.

    Values count by their distance from the first one, which keeps squares small; a variance that rounding alone can
    make is none.
    """
    v = np.concatenate([past, own])
    if not len(v):
        return own
    v = v - v[0]
    s, q = last_sums(v, window)[:-1], last_sums(v * v, window)[:-1]
    n = counts(len(s), window)
    mean, square = s / n, q / n
    var = square - mean * mean
    std = np.sqrt(np.where(var > 1e-13 * square, var, 0.0))
    there = (n >= least) & (std >= 1e-9)
    z = np.where(there, (v[1:] - mean) / np.where(there, std, 1.0), np.nan)
    return np.concatenate([[np.nan], z])[len(past) :]


class Flow:
    """The order-flow event of each row against the last book with two sides; the state is that book's top."""

    fields = ("ofi",)

    def tops(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        top = np.column_stack([r[c] for c in ("bid", "bid_qty", "ask", "ask_qty")])
        at = np.flatnonzero(~np.isnan(top).any(1))
        return at, top[at]

    @staticmethod
    def events(now: np.ndarray, before: np.ndarray) -> np.ndarray:
        (b, q, a, z), (pb, pq, pa, pz) = now.T, before.T
        return np.where(b > pb, q, np.where(b == pb, q - pq, -pq)) + np.where(a < pa, -z, np.where(a == pa, pz - z, pz))

    def part(self, r: Rows) -> np.ndarray:
        return self.tops(r)[1][-1:].ravel()

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return part if len(part) else state

    def first(self, r: Rows) -> np.ndarray:
        return self.tops(r)[1][:1].ravel()

    def between(self, state: np.ndarray, first: np.ndarray) -> float:
        return float(self.events(first[None], state[None])[0])

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at, top = self.tops(r)
        out = np.zeros(len(r["bid"]))
        whole = np.concatenate([state.reshape(-1, 4), top])
        got = self.events(whole[1:], whole[:-1])
        out[at[len(at) - len(got) :]] = got
        return [out]


class Scores:
    """z-scores of one column; infinite values and nan count in no window and have no score."""

    def __init__(self, column: str, name: str, window: int = 300):
        self.column, self.fields, self.window = column, (name,), window

    def part(self, r: Rows) -> np.ndarray:
        v = r[self.column]
        return v[np.isfinite(v)][-self.window :]

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.concatenate([state, part])[-self.window :]

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        v = r[self.column]
        at = np.flatnonzero(np.isfinite(v))
        return [spread_out(len(v), at, score(state, v[at], self.window))]


class Lagged:
    """z-scores of one column against the `window` rows before, by the sample deviation; 0 where there are less than two finite values or they are alike.

    Rows without a finite value fill a place of the window, but count for nothing.
    """

    def __init__(self, column: str, name: str, window: int):
        self.column, self.fields, self.window = column, (name,), window

    def part(self, r: Rows) -> np.ndarray:
        return r[self.column][-self.window :]

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.concatenate([state, part])[-self.window :]

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        own, w = r[self.column], self.window
        v = np.concatenate([state, own])
        at = np.flatnonzero(np.isfinite(v))
        known = np.zeros(len(v))
        known[at] = 1
        x = np.zeros(len(v))
        x[at] = v[at] - v[at[:1]]
        n, s, q = (last_sums(c, w) for c in (known, x, x * x))
        # the last row whose next finite value differs: windows after it hold one value alone
        turn = np.flatnonzero(np.diff(v[at]))
        differs = np.full(len(v), -w)
        differs[at[turn + 1]] = at[turn]
        alike = np.maximum.accumulate(differs) <= np.arange(len(v)) - w
        mean = s / np.maximum(n, 1)
        var = (q - s * mean) / np.maximum(n - 1, 1)
        there = (n >= 2) & ~alike & (var > 1e-24)
        z = (x[1:] - mean[:-1]) / np.sqrt(np.where(there, var, 1.0))[:-1]
        z = np.concatenate([[0.0], np.where(there[:-1] & (known[1:] > 0), z, 0.0)])
        return [z[len(state) : len(v)]]


class Rises:
    """The rise of the last known cumulative volume, never below 0; the state is that volume."""

    fields = ("tick_volume",)

    def part(self, r: Rows) -> np.ndarray:
        return r["volume"][~np.isnan(r["volume"])][-1:]

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        return part if len(part) else state

    def first(self, r: Rows) -> np.ndarray:
        return r["volume"][~np.isnan(r["volume"])][:1]

    def between(self, state: np.ndarray, first: np.ndarray) -> float:
        return max(0.0, float(first[0] - state[0]))

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        at = np.flatnonzero(~np.isnan(r["volume"]))
        v = r["volume"][at]
        before = np.concatenate([state, v])[: len(v)] if len(state) else np.concatenate([v[:1], v[:-1]])
        return [spread_out(len(r["volume"]), at, np.maximum(0.0, v - before))]


class ScoresOf:
    """z-scores of what another estimator gives; that field comes first, then its score.

    A stretch's first value is 0 in its part and set by join(), from the state before and the stretch's first row that counts.
    State: the other's, with its length ahead, then values.
    """

    def __init__(self, source: Flow | Rises, name: str, window: int = 300):
        self.source, self.fields, self.window = source, (*source.fields, name), window

    @staticmethod
    def taken(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An array that has its length ahead, and what follows it."""
        n = int(x[0])
        return x[1 : 1 + n], x[1 + n :]

    def part(self, r: Rows) -> np.ndarray:
        """First row, last row (each with its length ahead), the first value's place among the last ones (below 0: before them), values."""
        (v,) = self.source.run(NONE, r)
        first, last = self.source.first(r), self.source.part(r)
        if not len(v):
            return NONE
        known = np.isfinite(v)
        where = np.flatnonzero(~np.isnan(v) & self.counted(r))[:1]
        place = known[: where[0]].sum() if len(where) else 0
        tail = v[known][-self.window :]
        return np.concatenate([[len(first)], first, [len(last)], last, [place - (known.sum() - len(tail))], tail])

    def counted(self, r: Rows) -> np.ndarray:
        """Rows that the other estimator takes."""
        return ~np.isnan(r["volume"]) if isinstance(self.source, Rises) else ~np.isnan(np.column_stack([r[c] for c in ("bid", "bid_qty", "ask", "ask_qty")])).any(1)

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(part):
            return state
        before, values = self.taken(state) if len(state) else (NONE, NONE)
        first, rest = self.taken(part)
        last, rest = self.taken(rest)
        place, tail = int(rest[0]), rest[1:].copy()
        if len(first) and len(before) and place >= 0:
            tail[place] = self.source.between(before, first)
        now = self.source.join(before, last)
        return np.concatenate([[len(now)], now, np.concatenate([values, tail])[-self.window :]])

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        before, values = self.taken(state) if len(state) else (NONE, NONE)
        (v,) = self.source.run(before, r)
        at = np.flatnonzero(np.isfinite(v))
        return [v, spread_out(len(v), at, score(values, v[at], self.window))]


class Session:
    """Traded volume, VWAP, its deviation and the cumulative delta since the day's begin or the last fall of the volume.

    State: day, last volume of the day, sums of volume, money and money times price, delta, last trade's price and side, and
    how many sessions there were before.
    """

    fields = ("island", "dvol", "vwap", "vwap_stdev", "vwap_dev", "cum_delta")
    START = (np.nan, 0.0, 0.0, 0.0, 0.0, np.nan, 0.0)  # a new session: volume, sums, delta, price, side

    def walk(self, state: np.ndarray, r: Rows) -> tuple[np.ndarray, ...]:
        """Sessions' begins, volumes known, rises (nan if unknown before), their places and days' numbers."""
        day, n = r["day"], len(r["day"])
        begins = np.zeros(n, bool)
        begins[1:] = day[1:] != day[:-1]
        begins[0] = len(state) > 0 and day[0] != state[0]
        days = np.cumsum(begins)
        at = np.flatnonzero(np.isfinite(r["ltp"]) & ~np.isnan(r["volume"]))
        v = r["volume"][at]
        before = np.concatenate([[state[1] if len(state) and len(at) and days[at[0]] == 0 else np.nan], v[:-1]])[: len(v)]
        before[1:][days[at[1:]] != days[at[:-1]]] = np.nan
        falls = v < before
        rises = np.where(falls, 0.0, v - before)
        begins[at[falls]] = True
        return begins, v, rises, at, days

    @staticmethod
    def sides(prices: np.ndarray, price: float, side: float) -> np.ndarray:
        """Sides of trades after one at `price` of `side`."""
        change = np.sign(np.diff(np.concatenate([[price if not np.isnan(price) else prices[0]], prices]))) if len(prices) else prices
        return carried(change, side)

    def part(self, r: Rows) -> np.ndarray:
        """First and last day, the first known volume (if of the first day) with its price; of the trades after it in the first
        session sums, first and last price, volume before the first change of price, delta after it, last side; the
        number of sessions that begin; the last one's state; the last volume of the last day."""
        if not len(r["day"]):
            return NONE
        begins, v, rises, at, days = self.walk(NONE, r)
        island = np.cumsum(begins)
        lead = at[:1] if len(at) and days[at[0]] == 0 else at[:0]
        first = [v[0], r["ltp"][lead[0]]] if len(lead) else [np.nan, np.nan]
        traded = rises > 0
        p, amount, where = r["ltp"][at][traded], rises[traded], island[at][traded]

        def sums(k: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
            q, a = p[where == k], amount[where == k]
            return q, a, [a.sum(), (a * q).sum(), (a * q * q).sum()]

        q, a, s = sums(0)
        side = self.sides(q, np.nan, np.nan)
        open_, known = np.isnan(side), ~np.isnan(side)
        lead_part = [*s, q[0], q[-1], a[open_].sum(), (side[known] * a[known]).sum(), side[-1]] if len(q) else [0.0, 0.0, 0.0, np.nan, np.nan, 0.0, 0.0, np.nan]
        q, a, s = sums(int(island[-1]))
        side = self.sides(q, np.nan, 0.0)
        tail = [*s, (side * a).sum(), q[-1] if len(q) else np.nan, side[-1] if len(q) else 0.0]
        last = v[-1] if len(at) and days[at[-1]] == days[-1] else np.nan
        return np.array([r["day"][0], r["day"][-1], *first, *lead_part, island[-1], *tail, days[-1], last], float)

    def join(self, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(part):
            return state
        first_day, last_day, v1, p1, lv, lpv, lppv, lp1, lp2, open_, known, lside, n, tv, tpv, tppv, tdelta, tp, tside, n_days, last = part
        day, volume, v, pv, ppv, delta, price, side, island = state if len(state) else (np.nan, *self.START, 0.0)
        if len(state) and day != first_day:
            (volume, v, pv, ppv, delta, price, side), island = self.START, island + 1
        if not np.isnan(v1):
            if v1 < volume:
                (_, v, pv, ppv, delta, price, side), island = self.START, island + 1
            elif v1 > volume:
                a = v1 - volume
                side = (0.0 if np.isnan(price) else np.sign(p1 - price)) or side
                v, pv, ppv, delta, price = v + a, pv + a * p1, ppv + a * p1 * p1, delta + side * a, p1
            volume = v1
        if not np.isnan(lp1):
            side = (0.0 if np.isnan(price) else np.sign(lp1 - price)) or side
            v, pv, ppv, delta, price = v + lv, pv + lpv, ppv + lppv, delta + side * open_ + known, lp2
            side = side if np.isnan(lside) else lside
        if n:
            v, pv, ppv, delta, price, side, island = tv, tpv, tppv, tdelta, tp, tside, island + n
        if n_days or not np.isnan(last):
            volume = last
        return np.array([last_day, volume, v, pv, ppv, delta, price, side, island], float)

    def run(self, state: np.ndarray, r: Rows) -> list[np.ndarray]:
        begins, _, rises, at, _ = self.walk(state, r)
        n, ltp = len(begins), r["ltp"]
        amount = np.zeros(n)
        amount[at] = np.where(np.isnan(rises), 0.0, rises)
        money = np.where(amount > 0, amount * np.where(amount > 0, ltp, 0.0), 0.0)
        square = np.where(amount > 0, money * np.where(amount > 0, ltp, 0.0), 0.0)
        sums, delta = np.zeros((3, n)), np.zeros(n)
        edges = [0, *(np.flatnonzero(begins[1:]) + 1).tolist(), n]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            _, v, pv, ppv, d, price, side = state[1:8] if k == 0 and len(state) and not begins[0] else self.START
            for row, start, values in zip(sums, (v, pv, ppv), (amount, money, square)):
                row[a:b] = np.cumsum(np.concatenate([[start], values[a:b]]))[1:]
            trades = np.flatnonzero(amount[a:b] > 0)
            signed = np.zeros(b - a)
            signed[trades] = self.sides(ltp[a:b][trades], price, side) * amount[a:b][trades]
            delta[a:b] = d + np.cumsum(signed)
        v, pv, ppv = sums
        there = v > 0
        safe = np.where(there, v, 1.0)
        vwap = np.where(there, pv / safe, np.nan)
        stdev = np.where(there, np.sqrt(np.maximum(0.0, ppv / safe - vwap * vwap)), np.nan)
        dev = np.where(there & np.isfinite(ltp), (ltp - vwap) / np.where(there, vwap, 1.0), 0.0)
        island = np.cumsum(begins) + (state[8] if len(state) else 0)
        return [island, spread_out(n, at, np.where(np.isnan(rises), 0.0, rises)), vwap, stdev, dev, delta]
