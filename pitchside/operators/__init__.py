"""Operators: ``DataFrame(s), params -> DataFrame``; none collects to the driver."""
