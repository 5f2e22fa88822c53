"""Typed errors raised instead of silent no-ops or generic exceptions."""


class TabforgeError(Exception):
    """Base class for every error raised by the library."""


class UnknownOperation(TabforgeError):
    """A cleaning operation name that is not registered."""


class UnknownStep(TabforgeError):
    """A pipeline step name that is not registered."""


class ColumnNotFound(TabforgeError):
    """A referenced column does not exist in the DataFrame."""


class InvalidParameter(TabforgeError):
    """A parameter has a value the operator cannot use."""


class DatasetNotFound(TabforgeError):
    """No dataset with the given id is recorded in the catalog."""


class RunNotFound(TabforgeError):
    """No training run with the given id is recorded."""
