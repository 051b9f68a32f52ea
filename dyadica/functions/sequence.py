"""Per-trial expressions over the sixteen item columns.

Everything here is a plain Column unrolled over the eight positions, so a whole feature
set stays inside generated code and needs no shuffle. The unrolled text is built from
column names and parsed once (``F.expr``), which costs one call to the JVM instead of
hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = 8
LEFT = [f"L{i}" for i in range(1, ITEMS + 1)]
RIGHT = [f"R{i}" for i in range(1, ITEMS + 1)]
PAIR_FEATURES = ["pair_diff_std", "pair_diff_max", "pair_diff_min",
                 "pair_winner_balance", "pair_diff_entropy"]

Names = Sequence[str]


def _quoted(names: Names) -> list[str]:
    return [f"`{n}`" for n in names]


def _plus(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _present(names: Names) -> str:
    return _plus(f"if({c} is null, 0, 1)" for c in _quoted(names))


def _mean_of_present(names: Names) -> str:
    return f"({_plus(f'coalesce({c}, 0D)' for c in _quoted(names))} / nullif({_present(names)}, 0))"


def ev(left: Names = LEFT, right: Names = RIGHT) -> dict[str, Column]:
    """Expected value of each side (missing items are skipped) and the difference."""
    l, r = _mean_of_present(left), _mean_of_present(right)
    return {"EV_left": F.expr(l), "EV_right": F.expr(r), "EV_diff": F.expr(f"{l} - {r}")}


def normative_choice(ev_left: Column, ev_right: Column) -> Column:
    """1 when left has the strictly larger expected value; a tie means right."""
    return F.when(ev_left > ev_right, 1).otherwise(0)


def is_correct(choice: Column, normative: Column) -> Column:
    return (choice == normative).cast("int")


def tie_correct(mean_left: Column, mean_right: Column, choice: Column) -> Column:
    """Correctness where either answer to a tie counts as correct."""
    return (F.when(mean_left > mean_right, (choice == 1).cast("int"))
            .when(mean_right > mean_left, (choice == 0).cast("int"))
            .otherwise(1))


def items_mean(left: Names = LEFT, right: Names = RIGHT) -> Column:
    """Mean of all items that are present."""
    return F.expr(_mean_of_present([*left, *right]))


def complexity(ev_diff: str = "EV_diff", left: Names = LEFT, right: Names = RIGHT,
               mean: str | None = None, digits: int | None = 6) -> dict[str, Column]:
    """Closeness of the two sides plus the sample spread of all items (larger = harder).

    ``mean`` may name a column that already holds ``items_mean``. ``complexity`` is
    rounded so that thresholds taken from it do not depend on the order of a
    floating-point sum; ``digits=None`` keeps the raw value. (``rint`` of the scaled
    value is plain double work, where ``round`` goes through decimals.)
    """
    items = [*left, *right]
    mean = f"`{mean}`" if mean else _mean_of_present(items)
    squares = _plus(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0D)" for c in _quoted(items))
    spread = f"sqrt({squares} / nullif({_present(items)} - 1, 0))"
    score = f"(-abs(`{ev_diff}`) + {spread})"
    if digits is not None:
        score = f"rint({score} * 1e{digits}D) / 1e{digits}D"
    return {"complexity_diff": -F.abs(F.col(ev_diff)), "complexity_sd": F.expr(spread),
            "complexity": F.expr(score)}


def pair_differences(left: Names = LEFT, right: Names = RIGHT) -> list[Column]:
    """The eight item differences, left minus right."""
    return [F.col(l) - F.col(r) for l, r in zip(left, right)]


def pair_diff_spread(diffs: Names, mean: str) -> dict[str, Column]:
    """Population std, maximum and minimum of the difference columns; null if any is missing."""
    d, m = _quoted(diffs), f"`{mean}`"
    squares = _plus(f"({c} - {m}) * ({c} - {m})" for c in d)
    return {"pair_diff_std": F.expr(f"sqrt({squares} / {len(d)})"),
            "pair_diff_max": F.expr(f"if({m} is null, null, greatest({', '.join(d)}))"),
            "pair_diff_min": F.expr(f"if({m} is null, null, least({', '.join(d)}))")}


def pair_winner_balance(diffs: Names) -> Column:
    """How many positions left wins minus how many right wins."""
    return F.expr(_plus(f"case when {d} > 0 then 1 when {d} < 0 then -1 else 0 end"
                        for d in _quoted(diffs)))


def pair_diff_entropy(diffs: Names) -> Column:
    """Entropy (nats) of the distinct difference values.

    With ``c_i`` the multiplicity of the i-th difference this is
    ``ln(n^n / (c_1 * ... * c_n)) / n``: integer work and one logarithm. Missing
    differences count as one common value.
    """
    d, n = _quoted(diffs), len(diffs)
    counts = [_plus(["1"] + [f"int({d[min(i, j)]} <=> {d[max(i, j)]})" for j in range(n) if j != i])
              for i in range(n)]
    return F.expr(f"ln({float(n ** n)}D / ({' * '.join(counts)})) / {n}")


def side_mean(names: Names) -> Column:
    """Mean of one side; null when an item is missing."""
    return F.expr(f"{_plus(_quoted(names))} / {len(names)}")


def side_variance(names: Names, mean: str) -> Column:
    """Sample variance of one side around the column that holds its mean."""
    squares = _plus(f"({c} - `{mean}`) * ({c} - `{mean}`)" for c in _quoted(names))
    return F.expr(f"{squares} / {len(names) - 1}")


def stat_contrasts(mean_left: Column, mean_right: Column, var_left: Column, var_right: Column,
                   choice: Column) -> dict[str, Column]:
    """The statistics that follow from both sides' means and variances."""
    return {"diff_mean": mean_left - mean_right, "mean_var": (var_left + var_right) / 2,
            "diff_var": var_left - var_right, "response_left": choice.cast("int"),
            "correct": tie_correct(mean_left, mean_right, choice)}


def _leaky_fold(leak: float, left: Names, right: Names) -> str:
    steps = [f"(`{l}` - `{r}`)" for l, r in zip(left, right)]
    out = steps[0]
    for step in steps[1:]:
        out = f"({float(leak)!r}D * {out} + {step})"
    return out


def leaky_accumulate(leak: float, left: Names = LEFT, right: Names = RIGHT) -> Column:
    """Fold ``acc = leak * acc + (l - r)`` over the positions."""
    return F.expr(_leaky_fold(leak, left, right))


def leaky_choice(leak: float, left: Names = LEFT, right: Names = RIGHT) -> Column:
    """1 (left) when the accumulated evidence is positive; a tie means right."""
    return F.expr(f"if({_leaky_fold(leak, left, right)} > 0, 1, 0)")


def sequence_steps(left: Names = LEFT, right: Names = RIGHT) -> Column:
    """The trial as an ordered array of (left, right) steps."""
    steps = [f"named_struct('left', `{l}`, 'right', `{r}`)" for l, r in zip(left, right)]
    return F.expr(f"array({', '.join(steps)})")


def sigmoid(x: Column, k: Column | float, x0: Column | float) -> Column:
    """Logistic curve with the exponent held inside +-500."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    x0 = x0 if isinstance(x0, Column) else F.lit(float(x0))
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), k * (x - x0)))
    return 1.0 / (1.0 + F.exp(-z))


def calibration_gap(confidence_norm: Column, correct: Column) -> Column:
    return confidence_norm - correct.cast("double")


def interaction_terms(ev_diff: Column, complexity_col: Column, subject: Column) -> dict[str, Column]:
    strength = F.abs(ev_diff)
    return {"Evidence_Strength": strength,
            "EvStr_x_Complexity": strength * complexity_col,
            "Subject": subject.cast("string")}


