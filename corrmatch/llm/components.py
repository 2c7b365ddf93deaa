"""Connected components of links, as the engine finds them."""

from ..operators.components import both_ways, components

__all__ = ["both_ways", "components"]
