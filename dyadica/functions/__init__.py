from .sequence import (  # noqa: F401
    ITEMS, LEFT, RIGHT, PAIR_FEATURES, calibration_gap, complexity, ev,
    interaction_terms, is_correct, items_mean, leaky_accumulate, leaky_choice,
    normative_choice, pair_diff_entropy, pair_diff_spread, pair_differences,
    pair_winner_balance, sequence_steps, side_mean, side_variance, sigmoid, stat_contrasts,
    tie_correct,
)
from .tails import normal_two_sided, t_quantile, t_two_sided, wide_t_quantile  # noqa: F401
