"""Listing analytics on Spark: every operator takes and returns DataFrames."""

from forecourt.session import build_session

__all__ = ["build_session"]
