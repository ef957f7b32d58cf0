from .expand import explode_ordinals, largest_count
from .ordered import Before, Next, Ordered, RunningMin, RunningSum, Scan, UpTo
from .skew import DEFAULT_SKEW, HotKeys, SkewPolicy, find_hot_keys, skew_join, skew_join_both

__all__ = [
    "Before",
    "DEFAULT_SKEW",
    "HotKeys",
    "Next",
    "Ordered",
    "RunningMin",
    "RunningSum",
    "Scan",
    "SkewPolicy",
    "UpTo",
    "explode_ordinals",
    "largest_count",
    "find_hot_keys",
    "skew_join",
    "skew_join_both",
]
