"""Stateful operators on frame sequences, for tables and for streams."""
