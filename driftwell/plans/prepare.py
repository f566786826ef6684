"""From raw tables to one modelling table with DEV and OOT rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from driftwell.operators.history import APPLICANT, all_history_features, merge_features, merge_left
from driftwell.operators.timeline import (
    EXCLUDED_FEATURES, ID_COLUMNS, TIME_CANDIDATES, Windows, check_windows, cut_windows, model_columns,
    newest_only, resolve_time_column, time_proxy,
)
from driftwell.session import written_table


@dataclass
class Prepared:
    """Modelling table with ``split``, and what the columns mean."""

    data: DataFrame
    features: list[str]
    key: str
    target: str
    time: str
    windows: Windows
    audit: dict[str, int] = field(default_factory=dict)

    def split(self, name: str) -> DataFrame:
        return self.data.where(self.data["split"] == name)

    @property
    def dev(self) -> DataFrame:
        return self.split("dev")

    @property
    def oot(self) -> DataFrame:
        return self.split("oot")


def prepare(
    tables: Mapping[str, DataFrame],
    base: str = "application_train",
    key: str = APPLICANT,
    target: str = "TARGET",
    time: str = "recent_decision",
    windows: Windows = Windows(),
    excluded: tuple[str, ...] = EXCLUDED_FEATURES,
    materialise: bool = True,
    **aggregation,
) -> Prepared:
    """Time proxy, history features, left joins, windows.

    The window filter sits on top of the joins; since it rejects missing times, Catalyst turns the join
    that brings the time column into an inner join and filters it before the other joins. The audit looks
    at the base and that one table only. The proxy is taken from the histories' newest values per key, where the feature
    tables have them, so that no history is read again. The result is written once, partitioned by split and sorted by
    time inside the files, so that folds read few row groups and runs share it. ``plans`` from
    ``profile_histories`` may be passed on to spare the profile passes.
    """
    if base not in tables:
        raise ValueError(f"{base} is missing")
    histories = {name: table for name, table in tables.items() if name != base}
    made = all_history_features(histories, **aggregation)
    proxy = time_proxy(newest_only(histories, made, key), key)
    if proxy is not None:
        made.append(proxy)
    columns = [*tables[base].columns, *[c for table in made for c in table.columns if c != key]]
    time_column = resolve_time_column(columns, time, TIME_CANDIDATES)
    bearing = [t for t in made if time_column in t.columns]
    timed = tables[base]
    if bearing and time_column not in timed.columns:
        timed = merge_left(timed.select(key), bearing[0].select(key, time_column), key)
    audit = check_windows(timed, time_column, windows)
    # The table that carries the time goes first, so that its filter shrinks every later join.
    ordered = bearing[:1] + [t for t in made if not any(t is b for b in bearing[:1])]
    merged = cut_windows(merge_features(tables[base], ordered, key), time_column, windows)
    merged = merged.drop(*[c for c in ID_COLUMNS if c != key])
    data = written_table(merged.sortWithinPartitions(time_column), ["split"]) if materialise else merged
    features = model_columns(data, time_column, target, excluded, (key, *ID_COLUMNS, "split"))
    return Prepared(data, features, key, target, time_column, windows, audit)
