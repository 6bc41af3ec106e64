"""terrane: Bayesian multivariate spatial models on Spark tables."""

__version__ = "0.1.0"
