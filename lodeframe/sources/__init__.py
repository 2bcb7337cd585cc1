"""Readers of manifests, trajectories and calibrations."""
