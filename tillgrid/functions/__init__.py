"""Column-expression building blocks (dates, numbers, text)."""

from . import dates, numbers, text  # noqa: F401
