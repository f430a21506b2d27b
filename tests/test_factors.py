"""All factors and series functions against plain numpy, written out window by window on a panel of days by symbols."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark import catalog
from tidemark.operators.factors import FACTORS, factors

DAYS, SYMBOLS = 290, 6
BASE = ("open", "high", "low", "close", "volume")


def rolling(of):
    """A function of the last d rows of one symbol; missing in the first d - 1 rows."""

    def apply(*args):
        *series, d = args
        out = np.full(series[0].shape, np.nan)
        for t in range(d - 1, len(out)):
            for k in range(out.shape[1]):
                out[t, k] = of(*(x[t - d + 1 : t + 1, k] for x in series))
        return out

    return apply


def pearson(x, y):
    a, b = x - x.mean(), y - y.mean()
    size = np.sqrt((a @ a) * (b @ b))
    return a @ b / size if size > 1e-12 else 0.0


total, mean, low, high = rolling(np.sum), rolling(np.mean), rolling(np.min), rolling(np.max)
std = rolling(lambda x: np.std(x, ddof=1))
arg_high, arg_low = rolling(np.argmax), rolling(np.argmin)
ts_rank = rolling(lambda x: (x <= x[-1]).sum() / len(x))
corr = rolling(pearson)
cov = rolling(lambda x, y: (x - x.mean()) @ (y - y.mean()) / (len(x) - 1))
decay = rolling(lambda x: x @ np.arange(1, len(x) + 1) / np.arange(1, len(x) + 1).sum())


def delay(x, d):
    return np.vstack([np.full((d, x.shape[1]), np.nan), x[:-d]])


def delta(x, d):
    return x - delay(x, d)


def rank(x, digits=10, first=1):
    """first = 1: place / n; first = 0: place from 0 / (n - 1). Equal values go by symbol."""
    out = np.full(x.shape, np.nan)
    for t, row in enumerate(np.round(x, digits)):
        held = np.flatnonzero(~np.isnan(row))
        if len(held) >= 2:
            out[t, held[np.argsort(row[held], kind="stable")]] = (np.arange(len(held)) + first) / (len(held) - 1 + first)
    return out


def div(a, b):
    return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def scale(x):
    return div(x, np.nansum(np.abs(x), axis=1, keepdims=True) + 0 * x)


def want_factors(o, h, l, c, v):
    w, before = (o + h + l + c) / 4, delay(c, 1)
    r = np.where(before > 0, div(c - before, before), np.nan)
    logv = np.log(np.where(v > 0, v, np.nan))
    where, sign, flat = np.where, np.sign, lambda x: where(np.isnan(x), np.nan, 1.0)
    day, bend = delta(c, 1), (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    after_fall = where(r < 0, std(r, 20), c)
    trend5 = where((low(day, 5) > 0) | (high(day, 5) < 0), day, -day)
    trend4 = where((low(day, 4) > 0) | (high(day, 4) < 0), day, -day)
    pull = total(o, 5) * total(r, 5)
    month = mean(h, 20)
    slow = div(delta(mean(c, 100), 100), delay(c, 100))
    half = rank(total(corr(rank(v), rank(w), 6), 2) / 2)
    steps = sign(day) + sign(delay(c, 1) - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))
    place = div(c - low(l, 12), high(h, 12) - low(l, 12))
    return {
        "001": rank(arg_high(sign(after_fall) * after_fall**2, 5)) - 0.5,
        "002": -corr(rank(delta(logv, 2)), rank(div(c - o, o)), 6),
        "003": -corr(rank(o), rank(v), 10),
        "004": -ts_rank(rank(l), 9),
        "005": rank(o - mean(w, 10)) * -np.abs(rank(c - w)),
        "006": -corr(o, v, 10),
        "008": -rank(pull - delay(pull, 10)),
        "009": trend5,
        "010": rank(trend4),
        "011": (rank(high(w - c, 3)) + rank(low(w - c, 3))) * rank(delta(v, 3)),
        "012": sign(delta(v, 1)) * -day,
        "013": -rank(cov(rank(c), rank(v), 5)),
        "014": -rank(delta(r, 3)) * corr(o, v, 10),
        "015": -total(rank(corr(rank(h), rank(v), 3)), 3),
        "016": -rank(cov(rank(h), rank(v), 5)),
        "018": -rank(std(np.abs(c - o), 5) + (c - o) + corr(c, o, 10)),
        "019": -sign((c - delay(c, 7)) + delta(c, 7)) * (1 + rank(1 + total(r, 250))),
        "020": -rank(o - delay(h, 1)) * rank(o - before) * rank(o - delay(l, 1)),
        "022": -(delta(corr(h, v, 5), 5) * rank(std(c, 20))),
        "023": flat(month) * where(month < h, -delta(h, 2), 0.0),
        "024": where(slow < 0.05, -(c - low(c, 100)), -delta(c, 3)),
        "026": -high(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3),
        "027": flat(half) * where(half > 0.5, -1.0, 1.0),
        "030": (1 - rank(steps)) * div(total(v, 5), total(v, 20)),
        "032": scale(mean(c, 7) - c) + 20 * scale(corr(w, delay(c, 5), 230)),
        "033": rank(-(1 - div(o, c))),
        "034": rank((1 - rank(div(std(r, 2), std(r, 5)))) + (1 - rank(day))),
        "035": ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(r, 32)),
        "037": rank(corr(delay(o - c, 1), c, 200)) + rank(o - c),
        "038": -rank(ts_rank(c, 10)) * rank(div(c, o)),
        "040": -rank(std(h, 10)) * corr(h, v, 10),
        "041": np.sqrt(h * l) - w,
        "042": div(rank(w - c), rank(w + c)),
        "044": -corr(h, rank(v), 5),
        "045": -(rank(mean(delay(c, 5), 20)) * corr(c, v, 2) * rank(corr(total(c, 5), total(c, 20), 2), 6)),
        "046": where(bend > 0.25, -1.0, where(bend < 0, 1.0, -day)),
        "049": where(bend < -0.1, 1.0, -day),
        "050": -high(rank(corr(rank(v), rank(w), 5)), 5),
        "051": where(bend < -0.05, 1.0, -day),
        "053": -delta(div(c - l - (h - c), c - l), 9),
        "054": -div((l - c) * o**5, (l - h) * c**5),
        "055": -corr(rank(place), rank(v), 6),
    }


@pytest.fixture(scope="module")
def panel(spark):
    """Six symbols that start on different days; two of them have days without prices, some days have equal prices."""
    rng = np.random.default_rng(7)
    c = 40 * np.exp(np.cumsum(0.02 * rng.normal(size=(DAYS, SYMBOLS)), axis=0))
    c[100:106, 2] = c[99, 2]
    o = c * (1 + 0.01 * rng.normal(size=c.shape))
    h, l = np.maximum(o, c) * (1 + 0.01 * rng.random(c.shape)), np.minimum(o, c) * (1 - 0.01 * rng.random(c.shape))
    v = rng.integers(0, 400, c.shape).astype(float)
    gone = np.arange(DAYS)[:, None] < 2 * np.arange(SYMBOLS)
    gone[:, 4:] |= rng.random((DAYS, 2)) < 0.03
    o, h, l, c, v = (np.where(gone, np.nan, x) for x in (o, h, l, c, v))
    days = [date(2023, 1, 2) + timedelta(days=t) for t in range(DAYS)]
    rows = [(f"s{k}", days[t], *(None if gone[t, k] else float(x[t, k]) for x in (o, h, l, c, v))) for t in range(DAYS) for k in range(SYMBOLS)]
    schema = "symbol string, date date, " + ", ".join(f"{n} double" for n in BASE)
    return spark.createDataFrame(rows, schema).coalesce(1), (o, h, l, c, v)


def wide(found, name):
    return found.pivot(index="date", columns="symbol", values=name).to_numpy(float)


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_factors_against_numpy(panel):
    df, arrays = panel
    want = want_factors(*arrays)
    assert {f"alpha{n}" for n in want} == set(FACTORS)
    found = factors(df).toPandas()
    wrong = {n: int((~np.isclose(wide(found, f"alpha{n}"), x, rtol=1e-6, atol=1e-8, equal_nan=True)).sum()) for n, x in want.items()}
    assert not {n: k for n, k in wrong.items() if k}
    assert all(np.isfinite(x).sum() > 100 for x in want.values())


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_series_functions_against_numpy(panel):
    df, (o, h, l, c, v) = panel
    ret = div(delta(c, 1), delay(c, 1))
    want = {
        "delay": delay(c, 3), "delta": delta(c, 3), "ts_sum": total(v, 5), "ts_mean": mean(c, 5), "ts_std": std(ret, 5), "ts_min": low(l, 5), "ts_max": high(h, 5),
        "ts_argmax": arg_high(c, 5), "ts_argmin": arg_low(c, 5), "ts_rank": ts_rank(c, 5), "ts_corr": corr(c, v, 10), "ts_cov": cov(c, v, 10), "decay_linear": decay(c, 5),
        "cs_rank": rank(c), "cs_rank01": rank(c, first=0), "cs_scale": scale(ret), "sign": np.sign(ret), "log": np.log(np.where(v > 0, v, np.nan)),
        "signed_power": np.sign(ret) * np.abs(ret) ** 2, "vwap": (o + h + l + c) / 4, "returns": ret,
    }
    plan, names = catalog._series()
    assert set(names) == set(want)
    found = plan.apply(df, list(names.values())).toPandas()
    for n, x in want.items():
        assert np.allclose(wide(found, names[n]), x, rtol=1e-9, atol=1e-12, equal_nan=True), n
