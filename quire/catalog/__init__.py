"""Query modules; importing the package registers them all."""

from quire.catalog import blocks, chunks, context, inline, more, nested, planning, reports, retrieval, sections  # noqa: F401
