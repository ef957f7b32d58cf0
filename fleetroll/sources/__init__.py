from .container_defs import malformed_container_defs, read_container_defs
from .instance_records import (
    instance_document,
    lookup_stored_instances,
    read_instance_records,
    read_stored_instances,
    split_failures,
    stored_documents,
    write_instance_records,
)
from .registry_table import compact_registry, read_registry, upsert_registry
from .scratch import release_scratch, scratch_path
from .updates import malformed_updates, stream_updates

__all__ = [
    "compact_registry",
    "instance_document",
    "lookup_stored_instances",
    "malformed_container_defs",
    "malformed_updates",
    "read_container_defs",
    "read_instance_records",
    "read_registry",
    "read_stored_instances",
    "release_scratch",
    "scratch_path",
    "split_failures",
    "stored_documents",
    "stream_updates",
    "upsert_registry",
    "write_instance_records",
]
