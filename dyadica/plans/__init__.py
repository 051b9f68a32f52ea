from .reports import (  # noqa: F401
    advanced_report, clustered_lab, dataset_table, merge_report, run_all_datasets, run_bundle, stacked_trials,
)
from .runs import advanced_run, evidence_run, merge_run, read_sources  # noqa: F401
