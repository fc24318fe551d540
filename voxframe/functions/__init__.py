"""Row-wise functions on columns."""
