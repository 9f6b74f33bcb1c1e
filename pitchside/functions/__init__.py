"""Column helpers, exact quantiles and fixed values."""

from pitchside.functions import constants, exprs, quantiles

__all__ = ["constants", "exprs", "quantiles"]
