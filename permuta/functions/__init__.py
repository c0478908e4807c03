"""Column functions over patterns, weights and thresholds."""

from permuta.functions.patterns import (  # noqa: F401
    ceil_log2,
    forgetting_weight,
    fuse_ranks,
    group_label,
    groups_compatible,
    is_tie_free,
    pattern_text,
    prefix,
    rank_encode,
    step_direction,
    suffix,
    text_pattern,
)
from permuta.functions.thresholds import parse_thresholds, threshold_label  # noqa: F401
