"""Readers, normalisers and the month-partitioned store."""
