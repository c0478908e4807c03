"""Pattern mining and the operators around it."""

from permuta.operators.bounds import bound_tiers, pair_bounds, prune_rate, skew_rate  # noqa: F401
from permuta.operators.compare import common_keys, compare_folders, compare_patterns, comparison_status, same_work  # noqa: F401
from permuta.operators.mining import (  # noqa: F401
    candidate_pairs,
    extend_occurrences,
    frequent,
    mine,
    mine_sweep,
    pattern_support,
    seed_occurrences,
    tie_free_windows,
    window_occurrences,
)
from permuta.operators.prep import client_stats, concatenate_clients, interleave_clients, repeat_series, unpivot_clients  # noqa: F401
from permuta.operators.summary import against_baseline, best_config, exact_medians, pivot_metric, relative_to, result_summary, summarize_runs, unstable_counters, win_counts  # noqa: F401
from permuta.operators.work import generation_trace, occurrence_density, pair_mass, work_counters  # noqa: F401
