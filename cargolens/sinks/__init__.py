"""Report sinks.

A report of a large corpus does not fit one JSON document, so every sink writes JSON lines:
one folder per section, one record per line, written by all tasks in parallel.
"""

from cargolens.sinks.audit import audit_record, write_audit
from cargolens.sinks.index import with_index
from cargolens.sinks.json_report import json_report, write_json_report
from cargolens.sinks.sarif import sarif_report, write_sarif
from cargolens.sinks.sbom import components, sbom_report, vulnerabilities, write_sbom

__all__ = [
    "audit_record", "components", "json_report", "sarif_report", "sbom_report",
    "vulnerabilities", "with_index", "write_audit", "write_json_report", "write_sarif",
    "write_sbom",
]
