"""Clustering, blocking, evaluation, simulation and tuning."""
