"""Error kinds of the engine."""


class GraphError(Exception):
    """Base of all errors raised here."""


class SchemaError(GraphError):
    """A schema text or a schema change is not allowed."""


class InvalidCommand(GraphError):
    """A query asks for something that has no meaning."""


class TypeMismatch(GraphError):
    """A value does not have its field's type."""


class ValidationError(GraphError):
    """Data breaks the schema: unknown types or fields, wrong endpoints."""


class UniqueViolation(GraphError):
    """A unique field would hold a value twice."""


class NotFound(GraphError):
    """No node or edge has the id or key asked for."""


class NodeNotFound(NotFound):
    pass


class EdgeNotFound(NotFound):
    pass


class UnsupportedVersion(GraphError):
    """A stored graph has a format that this version does not read."""


class Conflict(GraphError):
    """Another writer committed first."""
