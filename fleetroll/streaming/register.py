"""Registration as a stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, micros
from ..model import ALREADY_EXISTS, REGISTERED
from .fold import BUCKETS, SLOT, Fold, folded, ship_by_value

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Registered(Fold):
    """State: whether the id is held, and until when it is remembered (null: for ever)."""

    state_schema = "known boolean, until bigint"
    start = (False, None)
    columns = ["us", "row"]
    output_schema = "row string, first boolean"

    def __init__(self, forget_us: int | None):
        self.forget_us = forget_us

    def deadline(self, state):
        return state[1]

    def expire(self, state):
        return self.start, None

    def fold(self, state, us, row):
        known, until = state
        first = np.zeros(len(us), bool)
        at = 0
        while True:
            if known:  # the next record that is not remembered any more
                at = len(us) if until is None else max(at, int(np.searchsorted(us, until, "right")))
            if at == len(us):
                return (known, until), [row.tolist(), first.tolist()]
            first[at] = True
            known, until = True, None if self.forget_us is None else int(us[at]) + self.forget_us
            at += 1


ship_by_value(__name__)


def stream_register(
    new: DataFrame,
    reg: DataFrame | None = None,
    order: Sequence[str] = (),
    forget_after: float | None = None,
    slot: float = SLOT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every record of ``new`` with its ``outcome``: REGISTERED for the first of an id in event time, else ALREADY_EXISTS.

    ``new`` has instance_id, ts with a watermark, and any further columns; records of one time go by the columns ``order``. A
    slot is closed before its records are looked at, so arrival order does not matter. Ids of the table ``reg`` are taken from
    the start. An id is remembered for ever, or ``forget_after`` seconds from its registration, which bounds the state.
    """
    slot_us = int(slot * MICROS)
    forget_us = None if forget_after is None else int(forget_after * MICROS)
    # Other columns of the same names may be part of the order.
    place = {f"order{k}": F.col(c) for k, c in enumerate(order)}
    records = new.select(
        F.col("instance_id"), micros("ts").alias("us"), F.to_json(F.struct("*"), _JSON).alias("row"),
        *[c.alias(name) for name, c in place.items()],
    )
    held = None
    if reg is not None:
        held = reg.select("instance_id").distinct().select(
            "instance_id", F.lit(True).alias("known"), F.lit(None).cast("bigint").alias("until")
        )
    rows = folded(records, "instance_id", Registered(forget_us), slot_us, list(place), held, buckets)
    outcome = F.when(F.col("first"), REGISTERED).otherwise(ALREADY_EXISTS)
    return rows.select(F.from_json("row", new.schema, _JSON).alias("r"), outcome.alias("outcome")).select("r.*", "outcome")
