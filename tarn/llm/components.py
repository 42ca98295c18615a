"""Connected components, as the graph operators have them."""

from ..operators.extensions import components

__all__ = ["components"]
