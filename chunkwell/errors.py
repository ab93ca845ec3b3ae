"""Errors raised at sinks and on the driver; bulk plans carry them as status columns instead."""


class UnsafePathError(ValueError):
    """A path leaves the repository's root."""


class FormatMismatchError(RuntimeError):
    """The recorded chunker signature isn't this engine's."""


class ChunkIntegrityError(Exception):
    """A payload isn't what its name says."""


class ConcurrentWriteError(RuntimeError):
    """Another writer has changed the table, or is changing it."""
