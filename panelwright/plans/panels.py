"""The three feature panels, built from a description of the source table.

Every panel is one projection over one lag window: a scan with its filter, one shuffle by
entity, one sort by date. The filter runs before the lags, so lags skip the rows it drops.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import band_share, ratio, round_ln
from panelwright.operators.lags import OFFSETS, with_lags


@dataclass(frozen=True)
class PanelSpec:
    """Which source column plays which role.

    ``log_prefix`` goes before the name of a logged column; empty, the logged column takes the
    source column's name, and all expressions still read the source.
    """

    entity: str
    date: str
    name: str | None
    cases: str
    deaths: str
    population: str
    positive: Sequence[str]
    log_statics: Sequence[str]
    statics: Sequence[str]
    percapita_statics: Sequence[str]
    shares: Mapping[str, str]
    percapita_shares: Sequence[str]
    bands: Mapping[str, Sequence[str]]
    log_prefix: str = "log_"
    case_lag: str = "CCT"
    death_lag: str = "DT"
    ratios: Sequence[str] = ("CC_PER_CAPITA", "D_PER_CAPITA", "D_PER_CC")
    offsets: Sequence[int] = field(default=OFFSETS)

    def keys(self) -> list[Column]:
        names = dict.fromkeys(c for c in (self.entity, self.date, self.name) if c)
        return [F.col(c) for c in names]

    def lags_of(self, name: str, skip: Sequence[int] = ()) -> list[str]:
        return [f"{name}_{k}" for k in self.offsets if k not in skip]

    def lag_keys(self, by_name: bool) -> tuple[list[str], list[str]]:
        if by_name and self.name:
            # Entities sharing a name mix; the entity key makes their order repeatable.
            return [self.name], [self.date, self.entity]
        return [self.entity], [self.date]

    def with_ratios(self) -> list[Column]:
        per_capita, deaths_per_capita, deaths_per_case = self.ratios
        return [
            ratio(self.cases, self.population).alias(per_capita),
            ratio(self.deaths, self.population).alias(deaths_per_capita),
            ratio(self.deaths, self.cases).alias(deaths_per_case),
        ]

    def with_bands(self) -> list[Column]:
        return [band_share(c, self.population).alias(n) for n, c in self.bands.items()]

    def log_columns(self) -> list[str]:
        """Names of the logged panel's columns, in order."""
        keys = dict.fromkeys(c for c in (self.entity, self.date, self.name) if c)
        logged = [f"{self.log_prefix}{c}" for c in (self.cases, self.deaths, self.population)]
        return [
            *keys, *logged, *self.ratios, *[f"{self.log_prefix}{c}" for c in self.log_statics],
            *self.statics, *self.bands, *self.shares, *(["ds"] if self.date != "ds" else []), "y",
            *self.lags_of(self.case_lag), *self.lags_of(self.death_lag),
        ]

    def logged(self, cols: Sequence[str]) -> list[Column]:
        return [round_ln(c).alias(f"{self.log_prefix}{c}") for c in cols]


def panel_filter(spec: PanelSpec) -> Column:
    """Source rows with every ``positive`` column above zero."""
    return reduce(and_, [F.col(c) > 0 for c in spec.positive])


def panel_log(source: DataFrame, spec: PanelSpec, by_name: bool = False, percapita: str | None = None) -> DataFrame:
    """Logged panel: rounded logs of cases, deaths, population and the log statics; ratios;
    lags of log cases and of raw deaths; bands; shares; raw cases as ``y``. With ``percapita`` also the lags of the
    per-capita ratios, named with it in front: one window then serves the models of both panels."""
    keep = [
        *spec.keys(),
        *spec.logged([spec.cases, spec.deaths, spec.population]),
        *spec.with_ratios(),
        *spec.logged(spec.log_statics),
        *[F.col(c) for c in spec.statics],
        *spec.with_bands(),
        *[ratio(c, spec.population).alias(n) for n, c in spec.shares.items()],
        *_series(spec),
    ]
    lags = {spec.case_lag: round_ln(spec.cases), spec.death_lag: F.col(spec.deaths)}
    if percapita is not None:
        lags |= {f"{percapita}{spec.case_lag}": ratio(spec.cases, spec.population), f"{percapita}{spec.death_lag}": ratio(spec.deaths, spec.population)}
    return _panel(source.where(panel_filter(spec)), spec, keep, lags, by_name)


def panel_percapita(source: DataFrame, spec: PanelSpec, by_name: bool = False) -> DataFrame:
    """Per-capita panel: raw cases, deaths and population; lags of the per-capita ratios; the
    per-capita statics and shares."""
    keep = [
        *spec.keys(),
        *[F.col(c) for c in (spec.cases, spec.deaths, spec.population)],
        *spec.with_ratios(),
        *spec.logged(spec.log_statics),
        *[F.col(c) for c in (*spec.statics, *spec.percapita_statics)],
        *spec.with_bands(),
        *[ratio(spec.shares[n], spec.population).alias(n) for n in spec.percapita_shares],
        *_series(spec),
    ]
    lags = {
        spec.case_lag: ratio(spec.cases, spec.population),
        spec.death_lag: ratio(spec.deaths, spec.population),
    }
    return _panel(source.where(panel_filter(spec)), spec, keep, lags, by_name)


def lag_frame(
    source: DataFrame, spec: PanelSpec, by_name: bool = False, keys: bool = False
) -> DataFrame:
    """Lags of raw cases and raw deaths over the unfiltered table."""
    lags = {spec.case_lag: F.col(spec.cases), spec.death_lag: F.col(spec.deaths)}
    return _panel(source, spec, spec.keys() if keys else [], lags, by_name)


def _series(spec: PanelSpec) -> list[Column]:
    ds = [] if spec.date == "ds" else [F.col(spec.date).cast("date").alias("ds")]
    return [*ds, F.col(spec.cases).alias("y")]


def _panel(
    rows: DataFrame,
    spec: PanelSpec,
    keep: Sequence[Column],
    lags: Mapping[str, Column],
    by_name: bool,
) -> DataFrame:
    by, order = spec.lag_keys(by_name)
    return with_lags(rows, keep, lags, by, order, spec.offsets, unique=not by_name)
