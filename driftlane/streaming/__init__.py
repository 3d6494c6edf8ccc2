"""Stateful detectors over streams, and their replay over tables."""
