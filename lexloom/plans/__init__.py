"""All queries, by group."""

from . import evaluation, language, layout, provenance, records, sinks, sources  # noqa: F401  (they register themselves)
