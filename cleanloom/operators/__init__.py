"""The cleaning operators. Importing this package fills the registry of steps."""

from cleanloom.operators import dedup, missing, outliers, profile, standardize, validate  # noqa: F401
