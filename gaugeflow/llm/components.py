"""Connected components, as the library has them."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
