from .events import dirty_trials, raw_layout, trials_from_events, trials_from_tables  # noqa: F401
from .layouts import (  # noqa: F401
    LAYOUTS, SOURCE_TAGS, add_trial_id, canonical_trials, nan_to_null, read_trials,
    resolve_response, resolve_sequences, strip_columns,
)
from .sinks import (  # noqa: F401
    UNIFIED_COLUMNS, STAT_COLUMNS, save_bucketed, write_corr, write_report, write_stats, write_trials,
    write_unified,
)
