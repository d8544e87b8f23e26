"""Connected components, as the library has them."""

from ..operators.graph import connected_components  # noqa: F401
