"""Operators for preparing training data at corpus scale.

Every operator takes DataFrames and returns DataFrames; none of them is used by the rest of the
library.
"""
