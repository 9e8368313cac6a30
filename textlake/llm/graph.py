"""Connected components of a graph of any size, without collecting it."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
