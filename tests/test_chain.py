"""The sampler against a plain loop over groups with md5 draws and no Spark."""

import hashlib
import math

import numpy as np
import pandas as pd

from salesmix.operators import moments
from salesmix.plans import gibbs
from salesmix.session import work_dir

P, DOF, SEED, DEFLATOR = 4, 6, 21, 3.0
MEAN, PRECISION = np.array([1.0, 0.0, -0.5, 0.2]), np.array([0.3, 0.1, 0.2, 0.4])


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def unit(d, at):
    return (int(d[at:at + 8], 16) + 0.5) / 2 ** 32


def normal(d):
    return math.sqrt(-2 * math.log(unit(d, 0))) * math.cos(2 * math.pi * unit(d, 8))


def normals(count, *key):
    return np.array([normal(digest(*key, k)) for k in range(count)])


def gamma(shape, scale, *key):
    d = shape - 1 / 3
    for k in range(32):
        g = digest(*key, k)
        v = (1 + normal(g) / math.sqrt(9 * d)) ** 3
        x = normal(g)
        if v > 0 and math.log(unit(g, 16)) < x * x / 2 + d - d * v + d * math.log(v):
            return d * v * scale
    raise AssertionError


def root_of_inverse(m):
    return np.linalg.inv(np.linalg.cholesky(m)).T


def pooled(b, centre, h2, s):
    v = sum(np.outer(x - centre, x - centre) for x in b) + P * np.eye(P)
    g = root_of_inverse(v) @ normals(P * DOF, SEED, s, h2, "W").reshape(P, DOF) / math.sqrt(DOF)
    w = g @ g.T
    precision = len(b) * w + np.diag(PRECISION)
    mu = np.linalg.solve(precision, w @ sum(b) + MEAN * PRECISION)
    return w, mu + root_of_inverse(precision) @ normals(P, SEED, s, h2, "mu")


def level1(groups, w, mu, h, h2, s):
    draws, ssr = {}, 0.0
    for h1, (x, y) in groups.items():
        precision = h * x.T @ x + w
        mean = np.linalg.solve(precision, h * x.T @ y + w @ mu)
        draws[h1] = mean + root_of_inverse(precision) @ normals(P, SEED, s, h2, h1, "b")
        ssr += ((y - x @ draws[h1]) ** 2).sum()
    v = sum(len(y) for _, y in groups.values()) / DEFLATOR
    return draws, gamma(v / 2, 2 / (v * (ssr / v)), SEED, s, h2, "h")


def chain(data, last, xs=("x1", "x2", "x3")):
    out = {}
    for h2, part in data.groupby("h2"):
        groups = {h1: (np.column_stack([np.ones(len(g)), g[list(xs)]]), g.y.to_numpy())
                  for h1, g in part.groupby("h1")}
        start = [np.linalg.lstsq(x, y, rcond=None)[0] for x, y in groups.values()]
        every = [np.concatenate(a) for a in zip(*groups.values())]
        w, mu = pooled(start, np.linalg.lstsq(*every, rcond=None)[0], h2, 1)
        draws, h = level1(groups, w, mu, 1.0, h2, 1)
        out.update({(1, h2, h1): b for h1, b in draws.items()})
        for s in range(2, last + 1):
            draws, new_h = level1(groups, w, mu, h, h2, s)
            w, mu = pooled(list(draws.values()), mu, h2, s)
            h = new_h
            out.update({(s, h2, h1): b for h1, b in draws.items()})
    return out


def test_every_draw(spark):
    rng = np.random.default_rng(8)
    rows = [pd.DataFrame(rng.normal(size=(size, 4)), columns=["y", "x1", "x2", "x3"]).assign(
        h2=h2, h1=f"g{g}") for h2, groups in (("A", 5), ("B", 3))
        for g, size in enumerate(rng.integers(3, 40, groups))]
    data = pd.concat(rows)
    spec = gibbs.FitSpec(p=P, df1=DOF, prior_mean=list(MEAN), prior_precision=list(PRECISION),
                         deflator=DEFLATOR, seed=SEED, draw_every=3)
    folder = work_dir(spark, "chain")
    facts = spark.createDataFrame(data)
    gibbs.gibbs_init(moments.group_gram(facts, "y", ["x1", "x2", "x3"]), spec, folder)
    got = gibbs.gibbs_run(spark, folder, spec, 2, 7).collect()
    want = chain(data, 7)
    assert len(got) == len(want) == 7 * 8
    for r in got:
        np.testing.assert_allclose(r.draw, want[r.iter, r.h2, r.h1], rtol=1e-6, atol=1e-8)


def test_every_draw_at_full_size(spark, monkeypatch):
    """13 drivers and the intercept, as the sales model has them: y far from 0, one small group."""
    p, rng = 14, np.random.default_rng(14)
    for name, value in (("P", p), ("DOF", p + 1), ("MEAN", np.r_[50.0, np.zeros(p - 1)]), ("PRECISION", np.full(p, 0.2))):
        monkeypatch.setattr(f"{__name__}.{name}", value)
    xs = [f"x{k}" for k in range(1, p)]
    rows = []
    for h2, groups in (("A", 4), ("B", 2)):
        for g in range(groups):
            size = 25 if g else 16
            part = pd.DataFrame(rng.normal(size=(size, p - 1)), columns=xs)
            part["x3"] = (part.x3 > 0).astype(float)
            part["y"] = 50 + part[xs].sum(axis=1) * 0.3 + rng.normal(scale=0.5, size=size)
            rows.append(part.assign(h2=h2, h1=f"g{g}"))
    data = pd.concat(rows)
    spec = gibbs.FitSpec(p=p, df1=p + 1, prior_mean=list(MEAN), prior_precision=list(PRECISION),
                         deflator=DEFLATOR, seed=SEED, draw_every=2)
    folder = work_dir(spark, "chain")
    gibbs.gibbs_init(moments.group_gram(spark.createDataFrame(data), "y", xs), spec, folder)
    got = gibbs.gibbs_run(spark, folder, spec, 2, 5).collect()
    want = chain(data, 5, xs)
    assert len(got) == len(want) == 5 * 6
    for r in got:
        np.testing.assert_allclose(r.draw, want[r.iter, r.h2, r.h1], rtol=1e-5, atol=1e-7)
