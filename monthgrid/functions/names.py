"""Markers in column names."""

from __future__ import annotations

# A column whose name holds one of these is derived and gets no missing flag.
DERIVED_MARKERS = ("_lag", "_diff", "_pctchg", "_roll", "_ewm", "_yoy")
# Columns left alone by imputation.
UNIMPUTED_MARKERS = ("_lag", "_diff", "_pctchg", "_roll", "_ewm")
# Columns that the optional zero fill covers.
ZERO_FILL_MARKERS = ("_lag", "_diff", "_pctchg")


def has_marker(column: str, markers: tuple[str, ...]) -> bool:
    return any(marker in column for marker in markers)
