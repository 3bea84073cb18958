"""Column functions with the semantics of text tables."""

from tabspark.functions.semantics import (  # noqa: F401
    as_int,
    blank,
    compare,
    fmt_float,
    like,
    num,
    num_trim,
    parse_bool,
    parse_date,
    render,
    sort_keys,
    text,
    trim,
)
