"""Stateful processors of the streaming extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_COLUMNS = ["page", "version", "month", "clicks", "delta", "rolling_avg_before", "drop_percentage"]


def page_anomalies(months: dict[str, int], window: int, std: float) -> list[tuple]:
    """A10 for one page: (month, clicks, delta, rolling average before, drop in percent) of the months that fall too far below."""
    names = sorted(months)
    clicks = [months[m] for m in names]
    if len(names) < window + 1:
        return []
    rolling = [sum(clicks[i - window + 1 : i + 1]) / window if i >= window - 1 else None for i in range(len(names))]
    deltas = [(i, clicks[i] - rolling[i - 1]) for i in range(1, len(names)) if rolling[i - 1] is not None]
    mean = sum(d for _, d in deltas) / len(deltas)
    deviation = (sum((d - mean) ** 2 for _, d in deltas) / len(deltas)) ** 0.5
    least = mean - std * (deviation if deviation > 0 else 1.0)
    drop = lambda i: (clicks[i - 1] - clicks[i]) / clicks[i - 1] * 100 if clicks[i - 1] > 0 else 0.0
    return [(names[i], clicks[i], d, rolling[i - 1], drop(i)) for i, d in deltas if d < least]


def anomaly_processor(window: int, std: float) -> StatefulProcessor:
    class Anomalies(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.months = handle.getMapState("months", "month string", "clicks bigint")
            self.batches = handle.getValueState("batches", "n bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                for month, clicks in zip(pdf["month"], pdf["clicks"], strict=True):
                    self.months.updateValue((month,), (int(clicks),))
            version = self.batches.get()[0] + 1 if self.batches.exists() else 1
            self.batches.update((version,))
            found = page_anomalies({k[0]: v[0] for k, v in self.months.iterator()}, window, std)
            yield pd.DataFrame([(key[0], version, *f) for f in found] or [(key[0], version, None, None, None, None, None)], columns=_COLUMNS)

        def close(self) -> None:
            pass

    return Anomalies()
