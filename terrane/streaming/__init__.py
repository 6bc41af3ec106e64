"""Prediction for places that arrive as a stream."""
