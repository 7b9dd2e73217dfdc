"""Writers: rewritten files, QA logs, records, run logs, evaluation tables."""
