"""The questions users ask, composed of operators."""
