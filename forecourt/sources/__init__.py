"""Readers, writers and result shapes."""
