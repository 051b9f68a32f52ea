"""Scaling, fits, classifiers and clustering (inventory E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, enrich, fits, models, sampling
from ..operators.scaling import standardize
from ..operators.summaries import STAT_FEATURES
from ..plans import advanced_report, clustered_lab, dataset_table, merge_report, run_all_datasets, run_bundle
from .base import lab, ledger, q6, query, rounded, sql
from .sampling import leak_grid_sql

# The run over all datasets searches boosted trees at one published depth, step and number of rounds, and leaves out the two
# deepest of four tree depths and the larger net (README); all others search the published grids.
_ALL_DATASETS = models.FULL_GRIDS | {"forest": models.FULL_GRIDS["forest"] | {"maxDepth": [5, 10]}, "boosting": {"maxIter": [100], "maxDepth": [4], "stepSize": [0.1]},
                                     "sequence_net": models.FULL_GRIDS["sequence_net"] | {"units": [32]}}

_Z = ", ".join(q6(f"(st.{c} - m.m_{c}) / m.s_{c}", c) for c in STAT_FEATURES)
_MOMENTS = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in STAT_FEATURES)


@query("e1_standardize", sql(f"with m as (select {_MOMENTS} from st) select trial_id, {_Z} from st, m", "st"))
def standardized(trials):
    rows = enrich.unified_stats(trials).select("trial_id", *STAT_FEATURES)
    return rounded(standardize(rows, STAT_FEATURES).apply(rows), *STAT_FEATURES)


# The step is compared at a point where no sum lands on a rounding tie.
_BETA = [0.1, 0.02, -0.03, 0.001]
_X = ["1", "s", "c", "s * c"]
_ETA = " + ".join(f"{b!r}::double * {x}" for b, x in zip(_BETA, _X))
_GEE_STEP = (["count(*) as n", q6("sum(e)", "t"), q6("sum(e * e)", "q")]
             + [q6(f"sum(w * {x})", f"s{j}") for j, x in enumerate(_X)]
             + [q6(f"sum(w * {x} * e)", f"g{j}") for j, x in enumerate(_X)]
             + [q6(f"sum(w * w * {_X[j]} * {_X[k]})", f"h{j}{k}") for j in range(4) for k in range(j, 4)])


@query("e2_gee_step", sql(f"""
with x as (select *, abs(EV_diff) as s, complexity as c from lab),
  m as (select *, 1 / (1 + exp(-({_ETA}))) as mu from x),
  w as (select *, sqrt(mu * (1 - mu)) as w, (choice - mu) / sqrt(mu * (1 - mu)) as e from m)
select cast(subject as varchar) as Subject, {', '.join(_GEE_STEP)} from w group by subject""", "lab"))
def gee_step(trials):
    """The per-subject sums of one iteration."""
    sums = fits.gee_subject_sums(fits.gee_design(lab(trials)), _BETA)
    return rounded(sums, *[c for c in sums.columns if c not in ("Subject", "n")])


def _solved(matrix: list[list[str]], rights: dict[str, list[str]], source: str, keep: list[str]) -> str:
    """SQL: the systems ``matrix`` x = right over the rows of ``source``, by elimination; each right is an array column.

    ``matrix`` and ``rights`` are expressions over ``source``; a positive definite matrix needs no pivoting.
    """
    p = len(matrix)
    cells = [f"{matrix[j][k]} as a{j}{k}" for j in range(p) for k in range(p)]
    cells += [f"{v} as r_{name}{j}" for name, right in rights.items() for j, v in enumerate(right)]
    text = f"(select {', '.join(keep + cells)} from {source})"
    for c in range(p):
        out = []
        for j in range(p):
            factor = f"(a{j}{c} / a{c}{c})"
            for k in range(c + 1, p):
                out.append(f"a{j}{k}" + (f" - {factor} * a{c}{k}" if j != c else "") + f" as a{j}{k}")
            for name in rights:
                out.append(f"r_{name}{j}" + (f" - {factor} * r_{name}{c}" if j != c else "") + f" as r_{name}{j}")
            out.append(f"a{j}{j} as a{j}{j}" if j <= c else f"0 as z{c}{j}")
        text = f"(select {', '.join(keep + out)} from {text})"
    solved = [f"[{', '.join(f'r_{name}{j} / a{j}{j}' for j in range(p))}] as {name}" for name in rights]
    return f"select {', '.join(keep + solved)} from {text}"


def _normal_sql(z: str, steps: int = 4000) -> str:
    """Two-sided p of a normal z by Simpson's rule over [0, |z|]."""
    top = f"least(abs({z}), 12.0)"
    return (f"(select greatest(0.0, 1 - 2 * sum((case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end) "
            f"* exp(-0.5 * pow({top} * i / {steps}.0, 2)) / sqrt(2 * pi())) * {top} / {steps}.0 / 3) from range({steps} + 1) g(i))")


def _gee_sql(steps: int = 20) -> str:
    """The published equations as a chain of steps: sums by subject, totals, a 4x4 solve and the next correlation."""
    parts = ["x as materialized (select choice, subject, abs(EV_diff) as s, complexity as c from lab)",
             "b0 as materialized (select [0.0, 0.0, 0.0, 0.0]::double[] as b, 0.0::double as alpha, 0.0::double as moved)"]
    pairs = [(j, k) for j in range(4) for k in range(j, 4)]
    full = [[f"b{min(j, k)}{max(j, k)}" for k in range(4)] for j in range(4)]
    for i in range(steps):
        eta = " + ".join(f"b[{j + 1}] * {x}" for j, x in enumerate(_X))
        parts.append(f"m{i} as materialized (select x.*, alpha, 1 / (1 + exp(-({eta}))) as mu from x, b{i})")
        sums = ", ".join([f"sum(w * {x}) as s{j}, sum(w * {x} * e) as g{j}" for j, x in enumerate(_X)]
                         + [f"sum(w * w * {_X[j]} * {_X[k]}) as h{j}{k}" for j, k in pairs])
        parts.append(f"""s{i} as materialized (select alpha, alpha / (1 + (n - 1) * alpha) as q, * exclude (alpha) from (
    select any_value(alpha) as alpha, count(*) as n, sum(e) as t, sum(e * e) as ee, {sums}
    from (select *, sqrt(mu * (1 - mu)) as w, (choice - mu) / sqrt(mu * (1 - mu)) as e from m{i}) group by subject))""")
        u = [f"((g{j} - q * s{j} * t) / (1 - alpha))" for j in range(4)]
        totals = ([f"sum({u[j]}) as u{j}" for j in range(4)]
                  + [f"sum((h{j}{k} - q * s{j} * s{k}) / (1 - alpha)) as b{j}{k}" for j, k in pairs]
                  + [f"sum({u[j]} * {u[k]}) as v{j}{k}" for j, k in pairs])
        parts.append(f"t{i} as materialized (select sum(n) as n, sum(ee) as ee, sum((t * t - ee) / 2) as crossed, "
                     f"sum(n * (n - 1) / 2) as pairs, {', '.join(totals)} from s{i})")
        units = {f"e{k}": [str(float(j == k)) for j in range(4)] for k in range(4)} if i == steps - 1 else {}
        solve = _solved(full, {"move": [f"u{j}" for j in range(4)], **units}, f"t{i}", ["ee", "n", "crossed", "pairs"] + [f"v{j}{k}" for j, k in pairs])
        parts.append(f"d{i} as materialized ({solve})")
        step = ", ".join(f"b[{j + 1}] + move[{j + 1}]" for j in range(4))
        parts.append(f"b{i + 1} as materialized (select [{step}] as b, case when pairs > 4 then crossed / (ee / (n - 4)) / (pairs - 4) else 0 end as alpha, "
                     f"greatest({', '.join(f'abs(move[{j + 1}])' for j in range(4))}) as moved from b{i}, d{i})")
    last = steps - 1
    spread = [" + ".join(f"e{j}[{a + 1}] * v{min(a, c)}{max(a, c)} * e{j}[{c + 1}]" for a in range(4) for c in range(4)) for j in range(4)]
    rows = " union all ".join(
        f"select '{term}' as term, b[{j + 1}] as coef, sqrt({spread[j]}) as se, alpha, moved from b{steps}, d{last}" for j, term in enumerate(fits.GEE_TERMS))
    parts.append(f"r as materialized (select *, coef / se as z from ({rows}))")
    return "with " + ",\n".join(parts) + f"""
select term, {q6('coef', 'coef')}, {q6('se', 'robust_se')}, {q6('z', 'z')}, {q6(_normal_sql('r.z'), 'p_value')},
  {q6('alpha', 'alpha')}, moved < 1e-8 as converged from r"""


@query("e2_fit_gee", sql(_gee_sql(), "lab"))
def fit_gee(trials):
    found = fits.fit_gee(lab(trials)).drop("iterations")
    return rounded(found, "coef", "robust_se", "z", "p_value", "alpha")


_P = "1 / (1 + exp(-0.1 * EV_diff))"
_JK, _JX = f"({_P} * (1 - {_P}) * EV_diff)", f"(-0.1 * {_P} * (1 - {_P}))"


@query("e3_psychometric_step", sql(f"""
select segment, count(*) as "rows", {q6(f'sum({_JK} * {_JK})', 'kk')}, {q6(f'sum({_JK} * {_JX})', 'kx')},
  {q6(f'sum({_JX} * {_JX})', 'xx')}, {q6(f'sum({_JK} * (choice - {_P}))', 'rk')},
  {q6(f'sum({_JX} * (choice - {_P}))', 'rx')}, {q6(f'sum(pow(choice - {_P}, 2))', 'sse')}
from seg group by segment""", "seg"))
def psychometric_step(trials):
    """The sums of the first iteration, at k = 0.1 and x0 = 0."""
    table = fits.psychometric_table(binning.split_easy_hard(lab(trials)))
    sums = fits.psychometric_sums(table, {"easy": (0.1, 0.0), "hard": (0.1, 0.0)})
    return rounded(sums, "kk", "kx", "xx", "rk", "rx", "sse")


def _psychometric_sql(steps: int = 25) -> str:
    """Least squares by a chain of slightly damped steps; rows of one segment and evidence are folded first."""
    parts = ["f as materialized (select segment, EV_diff as x, count(*) as n, sum(choice) as sy, sum(choice * choice) as syy from seg group by all)",
             "p0 as materialized (select distinct segment, 0.1::double as k, 0.0::double as x0, 1.0::double as moved from f)"]
    for i in range(steps):
        parts.append(f"""q{i} as materialized (
  select segment, k, x0, sum(n * jk * jk) as kk, sum(n * jk * jx) as kx, sum(n * jx * jx) as xx, sum(jk * r) as rk, sum(jx * r) as rx
  from (select *, p * (1 - p) * (x - x0) as jk, -p * (1 - p) * k as jx, sy - n * p as r
    from (select f.*, k, x0, 1 / (1 + exp(-greatest(-500, least(500, k * (x - x0))))) as p from f join p{i} using (segment)))
  group by all)""")
        lhs = [["kk * 1.000001", "kx"], ["kx", "xx * 1.000001"]]
        parts.append(f"e{i} as materialized ({_solved(lhs, {'move': ['rk', 'rx']}, f'q{i}', ['segment', 'k', 'x0'])})")
        parts.append(f"p{i + 1} as materialized (select segment, k + move[1] as k, x0 + move[2] as x0, greatest(abs(move[1]), abs(move[2])) as moved from e{i})")
    return "with " + ",\n".join(parts) + f"""
select segment, cast(sum(n) as bigint) as n, {q6('any_value(k)', 'k')}, {q6('any_value(x0)', 'x0')},
  {q6('sum(syy - 2 * p * sy + n * p * p)', 'sse')}, any_value(moved) < 1e-8 as converged
from (select f.*, k, x0, moved, 1 / (1 + exp(-greatest(-500, least(500, k * (x - x0))))) as p from f join p{steps} using (segment))
group by segment"""


@query("e3_fit_psychometric", sql(_psychometric_sql(), "seg"))
def fit_psychometric(trials):
    return rounded(fits.fit_psychometric(binning.split_easy_hard(lab(trials))).drop("iterations"), "k", "x0", "sse")


@query("e4_leaky_scores", sql(
    f"select grid_id, leak, round(accuracy, 6) + 0.0 as accuracy from ({leak_grid_sql(fits.LEAK_GRID)})"))
def leaky_scores(trials):
    return rounded(fits.leaky_scores(trials.where(F.col("source") == "lab")), "accuracy")


@query("e4_fit_leaky", sql(f"""
with g as materialized ({leak_grid_sql([fits.PUBLISHED_LEAK, *fits.LEAK_GRID])}),
  b as (select leak, accuracy from g order by accuracy desc, grid_id limit 1)
select b.leak, {q6('b.accuracy', 'accuracy')}, p.leak as published_leak,
  {q6('p.accuracy', 'published_accuracy')} from b, g p where p.grid_id = 0"""))
def fit_leaky(trials):
    return rounded(fits.fit_leaky(trials.where(F.col("source") == "lab")), "accuracy", "published_accuracy")


@query("e5_fit_logistic")
def fit_logistic(trials):
    return models.fit_logistic(enrich.unified_stats(trials))


def searched(trials, name: str, grid: dict | None = None) -> models.Fitted:
    table, cols = dataset_table(trials, "lab")
    split = sampling.stratified_split(table, "choice")
    scores = ledger(trials, "lab")
    if name == "sequence_net":
        return models.grid_sequence_net(split, "choice", grid=grid, ledger=scores)
    return models.grid_search(name, split, cols, "choice", grid=grid, ledger=scores)


def _metrics(trials, fitted: models.Fitted):
    return trials.sparkSession.createDataFrame(fitted.metrics(), "model string, metric string, value double")


@query("e6_grid_logistic")
def grid_logistic(trials):
    return _metrics(trials, searched(trials, "logistic"))


@query("e7_grid_forest")
def grid_forest(trials):
    return _metrics(trials, searched(trials, "forest"))


@query("e8_grid_boosting")
def grid_boosting(trials):
    return _metrics(trials, searched(trials, "boosting"))


@query("e9_grid_sequence_net")
def grid_sequence_net(trials):
    return _metrics(trials, searched(trials, "sequence_net"))


@query("e10_cross_validate")
def cross_validate(trials):
    return models.scores_table(trials.sparkSession, searched(trials, "logistic").grid_scores)


@query("e11_feature_importance")
def feature_importance(trials):
    return models.feature_importance(searched(trials, "forest"), trials.sparkSession)


@query("w6_top_importances")
def top_importances(trials):
    return models.top_importances(models.feature_importance(searched(trials, "forest"), trials.sparkSession))


@query("e12_cluster_residuals")
def cluster_residuals(trials):
    return clustered_lab(lab(trials), ledger=ledger(trials, "advanced")).select("trial_id", "residual", "cluster")


@query("e13_project_2d")
def project_2d(trials):
    rows = clustered_lab(lab(trials), ledger=ledger(trials, "advanced"))
    return models.project_2d(rows, enrich.feature_columns("lab", rows.columns))


@query("e14_run_bundle")
def bundle(trials):
    return run_bundle(*dataset_table(trials, "lab"), "lab", ledger=ledger(trials, "lab"))[0]


@query("e15_run_all_datasets")
def all_datasets(trials):
    return run_all_datasets(trials, _ALL_DATASETS, ledger=ledger(trials, "lab"))


@query("merge_report")
def merged(trials):
    return merge_report(enrich.unified_stats(trials))


@query("advanced_report")
def advanced(trials):
    return advanced_report(trials, ledger=ledger(trials, "advanced"))
