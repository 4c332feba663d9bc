"""Tables of a Pitman-Yor dish drawn from their law, given all other dishes.

With c customers, T tables of other dishes in the restaurant, strength s, discount d and the parent's probability p, a dish
has t tables with a weight of

    S_d(c, t) * prod over j < t of (s + d (T + j)) * p ** t,

S_d being the generalised Stirling numbers, S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t). Up to ``EXACT`` customers they
come from a table. Beyond, where a table would be too large, they come from the coefficients that make them,

    S_d(c, t) = c! / (t! d ** t) * [x ** c] (1 - (1 - x) ** d) ** t,

by the method of steepest descent, or where tables are few for their customers by the alternating sum for the coefficient,
which converges there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 256
#: Steepest descent is close from here on.
NEAR = 16.0
#: Dishes of a context that are drawn one after another; of more, some are drawn together. Few have over EXACT customers.
ROUNDS, LARGE_ROUNDS = 64, 8
#: Parts of a range that are looked at together in search of a mode.
SECTIONS = 9


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Of numbers from 1 on, by Stirling's series, ten above."""
    z = np.asarray(z, np.float64)
    shift = z.copy()
    for k in range(1, 10):
        shift *= z + k
    y, shift = z + 10, np.log(shift)
    return (y - 0.5) * np.log(y) - y + 0.91893853320467274 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


@lru_cache(8)
def log_stirling(n: int, discount: float) -> np.ndarray:
    """log S_d(c, t) at [c, t] up to n; minus infinity where it is 0. Workers keep the last ones for later tasks."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        grown = np.full(n + 1, -np.inf)
        stay = c - discount * t[: c + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            grown[: c + 1] = np.where(stay > 0, out[c, : c + 1] + np.log(stay), -np.inf)
        grown[1 : c + 2] = np.logaddexp(grown[1 : c + 2], out[c, : c + 1])
        out[c + 1] = grown
    out.flags.writeable = False
    return out


@lru_cache(8)
def stirling_steps(n: int, discount: float) -> np.ndarray:
    """S_d(c, t + 1) / S_d(c, t) at [c, t], 0 from c on."""
    table, out = log_stirling(n, discount), np.zeros((n + 1, n + 1))
    with np.errstate(invalid="ignore"):
        out[:, :-1] = np.exp(table[:, 1:] - table[:, :-1])
    return np.where(np.arange(n + 1) < np.arange(n + 1)[:, None], np.nan_to_num(out, posinf=0.0), 0.0)


def descent(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log u where x f'(x) / f(x) = c / t, with u = 1 - x and f = 1 - u ** d: Newton's steps, held between bounds."""
    target = np.log(c / t / discount)
    v = np.minimum(np.log(np.minimum(1.0, discount * t / c)) / (1 - discount), -1e-12)
    v = np.where(c / t < 1.5, np.log1p(-np.minimum(0.999999, 2 * (c / t - 1) / (1 - discount) + 1e-12)), v)
    low, high = np.full_like(v, -700.0), np.full_like(v, -1e-15)
    for _ in range(60):
        x, f = -np.expm1(v), -np.expm1(discount * v)
        value = np.log(x / f) + (discount - 1) * v - target
        high, low = np.where(value < 0, np.minimum(high, v), high), np.where(value > 0, np.maximum(low, v), low)
        slope = discount / f - 1 / x
        step = v - value / np.where(slope < 0, slope, -1.0)
        step = np.where((step >= low) & (step <= high), step, (low + high) / 2)  # a bound itself once it has converged
        moved = np.abs(step - v).max(initial=0.0)
        v = step
        if moved < 1e-9:
            break
    return v


def log_coefficient(c: np.ndarray, t: np.ndarray, discount: float, close: bool) -> np.ndarray:
    """log [x ** c] f ** t by steepest descent; where c u is small that is rough, and if ``close`` the sum is worked out."""
    v = descent(c, t, discount)
    x, f, ratio = -np.expm1(v), -np.expm1(discount * v), c / t
    spread = ratio * (1 + x * (1 - discount) * np.exp(-v) - ratio)
    out = t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * np.maximum(spread, 1e-300))
    if close:
        near = np.flatnonzero(c * np.exp(v) < NEAR)
        order = near[np.argsort(v[near] + np.log(c[near]))]
        for at in range(0, len(order), 1 << 12):
            k = order[at : at + (1 << 12)]
            most = c[k[-1]] * np.exp(v[k[-1]])
            told, sound = _series(c[k], t[k], discount, int(16 + 10 * most))
            out[k] = np.where(sound, told, out[k])
    return out


def _series(c: np.ndarray, t: np.ndarray, discount: float, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """log [x ** c] f ** t as the sum over j of (-1) ** j binomial(t, j) gamma(c - d j) / (gamma(-d j) c!), and whether enough
    is left of its terms to be sound."""
    j = np.arange(1, terms + 1)
    left = np.maximum(t[:, None] - j + 1, 0.0)
    with np.errstate(divide="ignore"):
        chosen = np.cumsum(np.log(left) - np.log(j), 1)
    # gamma(c - d j) / gamma(c), from one place for each different c.
    each, at = np.unique(c, return_inverse=True)
    ratio = log_gamma(np.maximum(each[:, None] - discount * j, 1.0)) - log_gamma(each)[:, None]
    size = chosen + ratio[at] + log_gamma(1 + discount * j)
    sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * discount * j) / np.pi
    top = size.max(1)
    total = (np.exp(size - top[:, None]) * sign).sum(1)
    return top + np.log(np.maximum(total, 1e-300)) - np.log(c), total > 1e-8


def log_weight(c: np.ndarray, t: np.ndarray, a: np.ndarray, log_p: np.ndarray, discount: float, close: bool = False) -> np.ndarray:
    """The law's logarithm for many customers, up to a constant of the dish; a = s / d + T. Elementwise."""
    return t * log_p + log_gamma(a + t) - log_gamma(t + 1) + log_coefficient(c, t, discount, close)


def _weights(customers, others, parent, strength: float, discount: float, steps: np.ndarray) -> np.ndarray:
    """Summed weights of 1, 2, ... tables, the first as 1: each is a multiple of the one before. Beyond the mode the multiples
    fall below 1, so what is lost below the smallest numbers has no weight; beyond the largest the sum isn't finite."""
    weight = steps[customers]
    weight[:, 1:] *= (discount * parent)[:, None] * ((strength / discount + others)[:, None] + np.arange(1, weight.shape[1]))
    weight[:, 0] = 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        np.cumprod(weight, 1, out=weight)
        return np.cumsum(weight, 1, out=weight)


def drawn(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """Tables of dishes; others: T of each. table is log_stirling(EXACT, discount)."""
    tables = np.minimum(customers, 1).astype(np.int64)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    # Dishes of up to twice as many customers side by side, of few dishes more; there is no weight beyond a dish's own.
    top = EXACT.bit_length()
    edge = np.searchsorted(customers[few], [1 << min(b, top) for b in range(1, top + 4, 1 if len(few) > 2048 else 2 if len(few) > 256 else 4)])
    steps = stirling_steps(EXACT, discount)
    for s, e in zip(edge[:-1], edge[1:]):
        width = int(customers[few[e - 1]]) if e > s else 1
        step = max(1, (1 << 18) // width)
        for at in range(s, e, step):
            k = few[at : min(e, at + step)]
            weight = _weights(customers[k], others[k], parent[k], strength, discount, steps[:, :width])
            wild = np.flatnonzero(~np.isfinite(weight[:, -1]))
            if len(wild):
                each = np.log((strength + discount * (others[k[wild], None] + np.arange(width))) * parent[k[wild], None])
                logs = np.cumsum(each, 1) + table[customers[k[wild]], 1 : width + 1]
                weight[wild] = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            tables[k] = 1 + (weight < rng.random(len(k))[:, None] * weight[:, -1:]).sum(1)
    many = np.flatnonzero(customers > EXACT)
    for at in range(0, len(many), 1024):
        k = many[at : at + 1024]
        tables[k] = _many(customers[k].astype(np.float64), strength / discount + others[k], np.log(parent[k]), discount, rng)
    return tables


def rounds(owner: np.ndarray, customers: np.ndarray) -> list[np.ndarray]:
    """Dishes of two customers or more, in the rounds in which they are drawn: of sorted owners' first dishes one a round, of
    more than there are rounds some together. Dishes of over EXACT customers have rounds of their own, after the others."""
    small = (customers > 1) & (customers <= EXACT)
    return _rounds(owner, np.flatnonzero(small), ROUNDS) + _rounds(owner, np.flatnonzero(customers > EXACT), LARGE_ROUNDS)


def _rounds(owner: np.ndarray, live: np.ndarray, most: int) -> list[np.ndarray]:
    if not len(live):
        return []
    of = owner[live]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[start, len(of)])
    rank, size = np.arange(len(of)) - np.repeat(start, n), np.repeat(n, n)
    turn = np.where(size > most, rank * most // size, rank)
    order = np.argsort(turn, kind="stable")
    return np.split(live[order], np.flatnonzero(np.diff(turn[order])) + 1)


def _many(c: np.ndarray, a: np.ndarray, log_p: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws for dishes of many customers: the mode by sections, then all numbers of tables around it that have weight."""
    # Every customer at a table of its own has no weight to speak of. Of the places looked at, the best one's neighbours
    # bound the mode.
    low, high = np.ones(len(c)), c - 1
    weight = lambda t: log_weight(c, t, a, log_p, discount)
    share = np.arange(1, SECTIONS)[:, None] / SECTIONS
    wide = lambda x: np.broadcast_to(x, (SECTIONS - 1, len(c))).ravel()
    while ((high - low) > 3).any():
        places = np.round(low * (high / low) ** share) if (high > 16 * low).any() else np.round(low + (high - low) * share)
        each = log_weight(wide(c), places.ravel(), wide(a), wide(log_p), discount).reshape(places.shape)
        best = each.argmax(0)
        every = np.concatenate([low[None], places, high[None]])
        k = np.arange(len(c))
        smaller, larger = every[best, k], every[best + 2, k]
        done = (smaller <= low) & (larger >= high)
        low, high = np.where(done & (high - low > 3), low + 1, smaller), np.where(done & (high - low > 3), high - 1, larger)
    mode = np.round((low + high) / 2)
    top = weight(mode)
    # How far weights of e ** -30 of the mode's lie, doubling.
    reach = np.full(len(c), 8.0)
    while True:
        left, right = np.maximum(mode - reach, 1), np.minimum(mode + reach, c - 1)
        short = ((weight(left) > top - 30) & (left > 1)) | ((weight(right) > top - 30) & (right < c - 1))
        if not short.any():
            break
        reach = np.where(short, 2 * reach, reach)
    left = np.where(mode < 200, 1.0, left)  # where few tables make the rough weight a poor guide
    first, n = left.astype(np.int64), (right - left + 1).astype(np.int64)
    out = np.zeros(len(c), np.int64)
    start = 0
    while start < len(c):  # so many numbers of tables at a time
        stop = max(start + 1, int(np.searchsorted(np.cumsum(n[start:]), 1 << 18)) + start)
        k = np.arange(start, min(stop, len(c)))
        row = np.repeat(k, n[k])
        t = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        w = np.exp(np.minimum(log_weight(c[row], t.astype(np.float64), a[row], log_p[row], discount, True) - top[row], 600))
        upto = np.cumsum(w)
        ends = np.cumsum(n[k])
        before = np.r_[0.0, upto[ends - 1]][:-1]
        hit = np.searchsorted(upto, before + rng.random(len(k)) * (upto[ends - 1] - before), side="left")
        out[k] = t[np.clip(hit, ends - n[k], ends - 1)]
        start = int(k[-1]) + 1
    return out
