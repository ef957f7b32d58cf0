"""Streaming forms of the event-time operators. Each gives the rows of its batch form once the watermark has passed."""

from .auto_down import stream_auto_down
from .correlate import stream_correlate
from .fleet import stream_fleet_state
from .liveness import stream_heartbeat, stream_outage
from .register import stream_register
from .run import run_to_table, use_rocksdb

__all__ = [
    "run_to_table",
    "stream_auto_down",
    "stream_correlate",
    "stream_fleet_state",
    "stream_heartbeat",
    "stream_outage",
    "stream_register",
    "use_rocksdb",
]
