"""Connected components of a link table."""

from __future__ import annotations

from convspark.operators.graph import roots

__all__ = ["roots"]
