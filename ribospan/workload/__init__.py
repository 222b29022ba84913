"""All registered queries."""

from ribospan.workload import metrics, motifs, score_tables, sequences, source_files, source_texts, variants  # noqa: F401
from ribospan.workload.registry import QUERIES, SQL  # noqa: F401
