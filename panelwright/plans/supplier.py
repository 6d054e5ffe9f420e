"""The same panels and formulas on the supplier x month stand-in table."""

from __future__ import annotations

from panelwright.plans.panels import PanelSpec
from panelwright.sources.standin import DISCOUNT_COUNTS, QUANTITY_BANDS, STATUSES

COARSE_BANDS = {"q01_10": 2, "q11_20": 2, "q21_30": 2, "q31_50": 4}


def _bands() -> dict[str, list[str]]:
    fine = [f"q{lo:02d}_{hi:02d}" for lo, hi in QUANTITY_BANDS]
    bands = {}
    for status in STATUSES:
        start = 0
        for coarse, size in COARSE_BANDS.items():
            bands[f"{status}_{coarse}"] = [f"{status}_{f}" for f in fine[start : start + size]]
            start += size
    return bands


SUPPLIER = PanelSpec(
    entity="entity_id",
    date="ds",
    name="entity_name",
    cases="cases",
    deaths="deaths",
    population="pop",
    positive=("acctbal", "deaths"),
    log_statics=("acctbal",),
    statics=("acctbal",),
    percapita_statics=("nation_id",),
    shares={f"share_{c}": c for c in DISCOUNT_COUNTS},
    percapita_shares=tuple(f"share_{c}" for c in DISCOUNT_COUNTS[1:]),
    bands=_bands(),
)

# The base groups left out of every model are one band and one share.
BASE_BAND, BASE_SHARE = "F_q21_30", "share_disc_00"
STATIC_TERMS = (
    "log_acctbal",
    *[s for s in SUPPLIER.shares if s != BASE_SHARE],
    *[b for b in SUPPLIER.bands if b != BASE_BAND],
)
CASE_LAGS = tuple(SUPPLIER.lags_of("CCT", skip=(21,)))
DEATH_LAGS = tuple(SUPPLIER.lags_of("DT", skip=(21,)))
FORMULAS = {
    "cases": ("log_cases", (*CASE_LAGS, "log_pop", *STATIC_TERMS)),
    "deaths": ("log_deaths", (*CASE_LAGS, *DEATH_LAGS, "log_pop", *STATIC_TERMS)),
    "percapita": ("CC_PER_CAPITA", (*CASE_LAGS, *STATIC_TERMS)),
    "forecast_error": ("error", ("log_pop", *STATIC_TERMS)),
}
SCALED = (
    "log_cases", "log_deaths", "log_pop", *SUPPLIER.ratios, "log_acctbal", "acctbal",
    *SUPPLIER.lags_of("CCT"), *SUPPLIER.lags_of("DT"), *SUPPLIER.bands, *SUPPLIER.shares, "y",
)
CORRELATED = (
    "log_cases", "log_deaths", "log_pop", "log_acctbal", "acctbal", *SUPPLIER.shares,
    *SUPPLIER.bands,
)
