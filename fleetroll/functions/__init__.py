from .text import deterministic_uuid, instance_id_parts, join_namespace, path_tail, qualified_uri
from .timing import as_of_micros, micros, slot_start, to_timestamp

__all__ = [
    "as_of_micros",
    "deterministic_uuid",
    "instance_id_parts",
    "join_namespace",
    "micros",
    "path_tail",
    "qualified_uri",
    "slot_start",
    "to_timestamp",
]
