"""Scalar functions: covariance kernels, transforms and log densities, as columns and in numpy."""
