"""All queries of the subpackage and, where SQL can say them, their DuckDB form."""

from __future__ import annotations

from folioscope.llm import (
    alignment, archive, coding, counting, decontamination, jaccard, language, merkle, packing, personal, quality,
    search, secrets,
)

_MODULES = (quality, coding, decontamination, search, packing, archive, personal, jaccard, counting, secrets,
            merkle, language, alignment)
QUERIES = {module.NAME: module.run_query for module in _MODULES}
ORACLE = {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
