"""Which parts of the engine are there."""

from __future__ import annotations


def dependency_status() -> dict[str, bool]:
    """Part to presence. All have a built-in implementation; only the training-data operators may be left out."""
    return {"excel": True, "similarity": True, "isolation_forest": True, "validation": True, "vector_store": True}
