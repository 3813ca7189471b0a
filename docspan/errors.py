"""Exceptions of the engine."""


class DocspanError(Exception):
    """Any error of the engine; the command line exits with exit_code."""

    exit_code = 1


class QueryError(DocspanError):
    """Query text that can't be read."""


class UnsupportedOperator(QueryError):
    """An operator, stage or accumulator that the language doesn't have."""


class EncryptionError(DocspanError):
    exit_code = 2


class IntegrityError(DocspanError):
    exit_code = 3


class DuplicateId(DocspanError):
    """An _id, or a value of a unique index, that is there already."""


class NotFound(DocspanError):
    exit_code = 4
