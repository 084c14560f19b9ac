from tidemark.functions.numeric import (  # noqa: F401
    clip,
    finite,
    growth,
    midpoint,
    percent_to_decimal,
    positive,
    r2,
    r4,
    r6,
    ratio,
    relative_change,
    revision,
    round_half_up,
    simple_return,
    weighted_available,
)
