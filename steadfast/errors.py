"""Errors of parameters and columns, raised before any plan is built; what depends on data gives NaN or null instead."""


class StatsError(ValueError):
    """Base of all errors here."""


class InvalidParameter(StatsError):
    pass


class InvalidProbability(InvalidParameter):
    pass


class InvalidWidth(InvalidParameter):
    pass


class InvalidConfidenceLevel(InvalidParameter):
    pass


class InvalidColumn(StatsError):
    pass


class TypeMismatch(StatsError):
    pass


class InvalidInput(StatsError):
    pass


class InsufficientData(StatsError):
    pass


class FeatureNotAvailable(StatsError):
    pass
