"""Fitting, prediction and simulation: chains as numpy kernels inside Spark tasks, moments by Spark."""
