"""Scalar column functions (cleaning conversions, labels, rounding, formats)."""

from carelens.functions.scalars import (  # noqa: F401
    categorize, half_even_share_percent, int_div, is_readmission, lenient_double,
    lenient_int, mysql_share_percent, null_if_token, pad_zip, parse_mdy,
    round_half_away, thousands, two_decimals, volume_tier,
)
