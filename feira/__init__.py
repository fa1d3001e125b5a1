"""feira — marketplace revenue and delivery analytics as lazy Spark DataFrames.

Every public function takes DataFrames and returns DataFrames built from
native Spark expressions; nothing is collected inside the library.
"""

from feira.session import build_session, ensure_checkpoint_dir, tune_session

__all__ = ["build_session", "ensure_checkpoint_dir", "tune_session"]
