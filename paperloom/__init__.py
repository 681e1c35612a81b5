"""paperloom: document collections as Spark tables.

Ingest, model-input preparation, model-output parsing, rule validation with
bounded repair, personal-data masking, verdicts, metrics and audit reports, all
as DataFrame transforms or Column expressions.
"""

from paperloom.plans.process import ProcessOptions, batch_metrics, process

__all__ = ["ProcessOptions", "batch_metrics", "process"]
