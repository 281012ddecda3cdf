"""Errors of the table engine."""


class TableError(Exception):
    """Base of all errors below."""


class MismatchedDataType(TableError):
    """An operand does not have the column's type."""


class OperationNotSupported(TableError):
    """The operation is not defined for the column's type or index."""


class WriteOperationsNotAllowed(TableError):
    """A read-only batch holds a write command."""


class DuplicateColumn(TableError):
    """Two columns share a name."""


class UnknownColumn(TableError):
    """A predicate names a column that the table does not have."""


class ConstraintCheckFailed(TableError):
    """Rows or results do not fit the declared schema."""


class SchemaError(TableError):
    """A schema description is not valid."""
