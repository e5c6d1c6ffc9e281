"""A corpus pipeline: language ID, exact and near deduplication, benchmark decontamination, packing.

The stages are in ``parcelflow.llm.stages``.
"""

from parcelflow.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
