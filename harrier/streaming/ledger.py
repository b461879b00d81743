"""A budget that is reserved before a call and settled after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from harrier.shipping import ship

MICRO = 1_000_000


def settled(events: DataFrame, budget: float, day: str = "day") -> DataFrame:
    """``events (day, seq, request, kind, usd)`` with ``fits`` and ``spent``, in micro-dollars.

    A ``reserve`` fits if the day's total with it is within the budget; one that doesn't
    leaves the total as it was. A ``settle`` puts the actual cost in place of what its
    request reserved; with a null cost the reservation stays, and without a reservation
    that fits, nothing changes (``fits`` is null). Each decision rests on all before it, so
    a day is walked in order: its rows come sorted and by batches, and what is kept is
    the total and the open reservations.
    """
    ship(events.sparkSession)
    rows = events.select(day, "seq", "request", "kind", "usd").repartition(day).sortWithinPartitions(day, "seq")
    kinds = {name: kind for name, kind in rows.dtypes}
    limit = int(budget * MICRO)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, held = object(), 0, {}
        for batch in batches:
            fits, spent = [], []
            for of, request, kind, usd in zip(batch[day], batch["request"], batch["kind"], batch["usd"], strict=True):
                if of != at:
                    at, total, held = of, 0, {}
                cost = None if pd.isna(usd) else int(usd * MICRO)
                if kind == "reserve":
                    micros = max(1, (cost or 0) + 1)
                    fits.append(total + micros <= limit)
                    if fits[-1]:
                        total, held[request] = total + micros, micros
                else:
                    fits.append(None)
                    micros = held.pop(request, None)
                    if micros is not None and cost is not None:
                        total += cost - micros
                spent.append(total)
            yield batch.assign(fits=pd.Series(fits, index=batch.index, dtype="object"), spent=spent)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    return rows.mapInPandas(walk, f"{schema}, fits boolean, spent long")
