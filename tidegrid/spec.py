"""Names of the roles a table's columns play, and the parameters of a run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns are the series key, the timestamp and the target.

    ``by`` holds further key columns (a fold number, a sample label). ``ties`` orders rows that share a
    timestamp, for tables that are not unique on (key, timestamp). ``id=None`` means one single series.
    ``statics`` are columns with one value per series and ``holidays`` asks for the fixed public holidays, both as features of the
    regressions. ``known`` are numeric columns whose values are known ahead, features of the regressions too: rows without a target after a series'
    last one give them for the dates to forecast. ``longest`` is an upper bound of the rows of any series, if known; it spares the operators from measuring.
    """

    id: str | None = "item_id"
    ts: str = "ts"
    target: str = "y"
    by: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    freq: str = "D"
    statics: tuple[str, ...] = ()
    holidays: bool = False
    known: tuple[str, ...] = ()
    longest: int | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.by, *([self.id] if self.id else [])]

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.ties]

    def replace(self, **changes) -> "SeriesSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class RunParams:
    """Parameters of a training run; stored with the run as one JSON document."""

    # The names under which callers send the parameters.
    datetime_column: str
    target_column: str
    item_id_column: str
    evaluation_metric: str
    frequency: str = "auto"
    fill_missing_method: str = "None"
    fill_group_columns: tuple[str, ...] = ()
    use_russian_holidays: bool = False
    models_to_train: tuple[str, ...] | str | None = None
    predict_mean_only: bool = False
    prediction_length: int = 3
    static_feature_columns: tuple[str, ...] = ()
    pycaret_models: tuple[str, ...] | str | None = None
    download_table_name: str | None = None
    upload_table_name: str | None = None
    upload_table_schema: str | None = None
    season: int = field(default=7)
    known_columns: tuple[str, ...] = ()
    snap_to_grid: bool = False

    def spec(self) -> SeriesSpec:
        return SeriesSpec(
            id=self.item_id_column,
            ts=self.datetime_column,
            target=self.target_column,
            freq=freq_code(self.frequency) or "D",
            statics=tuple(self.static_feature_columns),
            holidays=self.use_russian_holidays,
            known=tuple(self.known_columns),
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def freq_code(freq: str | None) -> str | None:
    """First token of a frequency such as ``'D (daily)'``; None when the frequency is left open."""
    if not freq or freq.strip().lower().split()[0] == "auto":
        return None
    return freq.split()[0].upper()
