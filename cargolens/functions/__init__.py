"""Column functions: every helper is a built-in Spark expression, no Python per row."""

from cargolens.functions.binary import (
    be_uint,
    byte_at,
    bytes_at,
    latin1,
    le_uint,
    starts_with_bytes,
)
from cargolens.functions.levels import (
    code_rank,
    confidence_rank,
    confidence_score,
    parse_severity,
    sarif_level,
    severity_label,
    severity_level,
)
from cargolens.functions.network import (
    is_ipv4,
    is_private_ip,
    parent_domains,
    trusted_domain,
    url_host,
)
from cargolens.functions.text import (
    basename,
    byte_offset,
    compliance_tag,
    cwe_number,
    dotted_prefixes,
    extension,
    has_position_anchor,
    human_size,
    is_companion_file,
    is_object_dtype,
    is_tensor_member,
    is_unsafe_member_name,
    iso_timestamp,
    json_version,
    localized,
    location_call,
    location_key,
    location_offset,
    location_symbol,
    reference_uri,
    split_symbol,
    uri_path,
)

__all__ = [
    "basename", "be_uint", "byte_at", "byte_offset", "bytes_at", "code_rank",
    "compliance_tag", "confidence_rank", "confidence_score", "cwe_number",
    "dotted_prefixes", "extension", "has_position_anchor", "human_size",
    "is_companion_file", "is_ipv4", "is_object_dtype", "is_private_ip",
    "is_tensor_member", "is_unsafe_member_name", "iso_timestamp", "json_version",
    "latin1", "le_uint", "localized", "location_call", "location_key",
    "location_offset", "location_symbol", "parent_domains", "parse_severity",
    "reference_uri", "sarif_level", "severity_label", "severity_level",
    "split_symbol", "starts_with_bytes", "trusted_domain", "uri_path", "url_host",
]
