"""Connected components and tables in the checkpoint folder, as the rest of the library has them."""

from tidewire.operators.graph import components, use_checkpoints, written

__all__ = ["components", "use_checkpoints", "written"]
