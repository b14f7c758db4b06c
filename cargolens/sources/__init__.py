"""Sources: artifact inventories, text tables, rule packs, policies, tensor headers."""

from cargolens.sources.artifacts import (
    drop_companions,
    hash_content,
    list_artifacts,
    read_content,
    with_size_cap,
)
from cargolens.sources.config_refs import config_references
from cargolens.sources.packs import (
    allowlist_from,
    bundle_patterns_from,
    load_pack,
    patterns_from,
    prefixes_from,
    secret_rules_from,
)
from cargolens.sources.policy import PRESETS, Policy, load_policy, unknown_policy_keys
from cargolens.sources.strings import min_length, strings_from
from cargolens.sources.tensors import tensor_headers

__all__ = [
    "PRESETS", "Policy", "allowlist_from", "bundle_patterns_from", "config_references",
    "drop_companions", "hash_content", "list_artifacts", "load_pack", "load_policy",
    "min_length", "patterns_from", "prefixes_from", "read_content", "secret_rules_from", "strings_from",
    "tensor_headers", "unknown_policy_keys", "with_size_cap",
]
