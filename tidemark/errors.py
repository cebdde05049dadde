"""Errors; a series that cannot be fitted reports its own in the params table instead."""


class DataValidationError(ValueError):
    """The data lack something that the model needs."""


class PredictionError(RuntimeError):
    """A forecast was asked for that the model cannot give."""
