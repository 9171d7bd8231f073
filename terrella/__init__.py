"""An analytics engine for synthetic worlds, on Spark."""
