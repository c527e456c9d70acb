from pmtspark.functions.recode import (
    any3,
    bin_left,
    bin_right,
    collapse_levels,
    cross_levels,
    if_known,
    in_set,
    left_labels,
    max_or_neg_inf,
    recode,
    safe_ratio,
    thousands,
    yes_no,
)
from pmtspark.functions.targeting import (
    cell_sums,
    confusion_exprs,
    derived_measures,
    targeting_exprs,
    weighted_share,
)

__all__ = [
    "any3",
    "bin_left",
    "bin_right",
    "cell_sums",
    "collapse_levels",
    "confusion_exprs",
    "cross_levels",
    "derived_measures",
    "if_known",
    "in_set",
    "left_labels",
    "max_or_neg_inf",
    "recode",
    "safe_ratio",
    "targeting_exprs",
    "thousands",
    "weighted_share",
    "yes_no",
]
