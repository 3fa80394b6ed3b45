"""Sources and sinks by format name or file extension."""

from . import registry  # noqa: F401
