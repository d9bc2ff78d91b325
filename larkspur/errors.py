"""Errors of the public interface."""


class InvalidInput(ValueError):
    """A filter, option, name or record is malformed."""


class NotFound(LookupError):
    """A named database, schema, collection or route does not exist."""


class ConstraintViolation(InvalidInput):
    """A write was refused; nothing of it was stored."""


class Restricted(ConstraintViolation):
    """A delete was refused because other records refer to the target."""
