"""Column-level semantics shared by all operators."""

from counterlift.functions.columns import (  # noqa: F401
    ceil_long,
    greatest_strict,
    labelled_bucket,
    packed_part,
    pair_diff,
    prefix_before_dash,
    random_key,
    safe_divide,
    split_list,
    trailing_digit,
)
from counterlift.functions.dates import (  # noqa: F401
    local_date,
    week_diff_sunday,
    week_start,
    weekday_name,
    within_dates_inclusive,
)
