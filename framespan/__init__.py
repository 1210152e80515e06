"""framespan: frame sequences and the geometry derived from them, as Spark tables."""

from framespan.session import cut, ensure_checkpoint_dir, local_session

__all__ = ["cut", "ensure_checkpoint_dir", "local_session"]
