"""Change-only progress feed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofline import catalogs as C


def changes(snapshots: DataFrame, key: str, at: str, status: str, payload: Sequence[str],
            terminal: Sequence[str] = C.TERMINAL_STATUSES) -> DataFrame:
    """One row per snapshot that differs from the last one sent; a final status also sends ``done``.

    The state per job is its last payload and whether it has ended; later snapshots of an ended job are
    ignored.
    """
    kinds = dict(snapshots.dtypes)
    schema = f"`{key}` {kinds[key]}, event string, payload string"
    ends = set(terminal)

    def update(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (None, False)
        rows = []
        arrived = sorted(row for batch in batches for row in zip(batch["_at"], batch["_payload"], batch["_status"]))
        for _, text, current in arrived:
            if ended:
                break
            if text != last:
                rows.append((owner[0], "data", text))
                last = text
            if current in ends:
                rows.append((owner[0], "done", text))
                ended = True
        state.update((last, ended))
        yield pd.DataFrame(rows, columns=[key, "event", "payload"])

    text = F.to_json(F.struct(status, *payload))
    slim = snapshots.select(
        key, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), text.alias("_payload"), F.col(status).alias("_status")
    )
    return slim.groupBy(key).applyInPandasWithState(
        update, schema, "last string, ended boolean", "append", GroupStateTimeout.NoTimeout
    )
