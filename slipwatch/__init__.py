"""Panel early-warning analytics as Spark DataFrame operators."""

from slipwatch.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
