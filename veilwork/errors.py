"""Exceptions of the driver-side interfaces. Row-level failures are columns of violations instead."""


class VeilError(Exception):
    """Base of all."""


class ConfigError(VeilError, ValueError):
    """An option is out of its domain."""


class AuditError(VeilError):
    """The log cannot be read or written."""


class ChainIntegrityError(AuditError):
    """The log's chain is broken where it must be extended."""


class SchemaViolation(AuditError):
    """A record holds what a log may not hold."""


class SessionError(VeilError):
    """A session is used wrongly."""


class ScopeError(SessionError):
    """A category or span is not in the session's scope."""


class SessionTimeout(SessionError):
    """The session's lifetime is over."""


class SessionState(SessionError):
    """The session is not open."""


class StreamTooLong(VeilError):
    """A stream is over its cap."""
