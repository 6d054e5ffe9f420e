"""County x day panel of the public-health table: columns, bands, formulas.

The names below are the input and output schema users of such a table rely on.
"""

from __future__ import annotations

from panelwright.plans.panels import PanelSpec

# Source column names, age bands, output names and model terms.
AGE_BANDS = {
    "0_TO_17": ["UNDER_5", "5_TO_9", "10_TO_14", "15_TO_17"],
    "18_TO_29": ["18_TO_19", "20", "21", "22_TO_24", "25_TO_29"],
    "30_TO_49": ["30_TO_34", "35_TO_39", "40_TO_44", "45_TO_49"],
    "OVER_50": [
        "50_TO_54", "55_TO_59", "60_TO_61", "62_TO_64", "65_TO_66",
        "67_TO_69", "70_TO_74", "75_TO_79", "80_TO_84", "85_AND_OVER",
    ],
}
SEXES = ("MALE", "FEMALE")
SHARES = {
    "PERCENT_NONCITIZEN": "NOT_US_CITIZEN_POP",
    "PERCENT_WHITE": "WHITE_POP",
    "PERCENT_BLACK": "BLACK_POP",
    "PERCENT_ASIAN": "ASIAN_POP",
    "PERCENT_HISPANIC": "HISPANIC_POP",
    "PERCENT_AMERINDIAN": "AMERINDIAN_POP",
    "PERCENT_OTHER_RACE": "OTHER_RACE_POP",
    "PERCENT_MULTIRACIAL": "TWO_OR_MORE_RACES_POP",
    "PERCENT_HISPANIC_ANY_RACE": "HISPANIC_ANY_RACE",
}
STATICS = (
    "DIABETES_RATE", "SMOKING_RATE", "PERCENT_DEM", "PERCENT_REP", "RPL_THEMES", "GINI_INDEX",
    "EP_DISABL", "EP_MINRTY", "EP_CROWD", "EP_GROUPQ", "EP_UNINSUR", "EP_NOHSDP",
)

COUNTY = PanelSpec(
    entity="FIPS",
    date="DATE",
    name="COUNTY",
    cases="CONFIRMED_CASES",
    deaths="DEATHS",
    population="E_TOTPOP",
    positive=("RPL_THEMES", "DEATHS"),
    log_statics=("MEDIAN_INCOME",),
    statics=STATICS,
    percapita_statics=("EP_PCI", "EP_POV"),
    shares=SHARES,
    percapita_shares=tuple(n for n in SHARES if n != "PERCENT_WHITE"),
    bands={f"{s}_{b}": [f"{s}_{f}" for f in fine] for s in SEXES for b, fine in AGE_BANDS.items()},
    log_prefix="",
)

# The model terms. MALE_30_TO_49 and PERCENT_WHITE are the base groups.
STATIC_TERMS = (
    "MEDIAN_INCOME", "EP_CROWD", "EP_DISABL", "EP_GROUPQ", "EP_NOHSDP", "EP_UNINSUR",
    "RPL_THEMES", "PERCENT_DEM", "DIABETES_RATE", "SMOKING_RATE", "PERCENT_HISPANIC",
    "PERCENT_BLACK", "PERCENT_ASIAN", "PERCENT_AMERINDIAN", "PERCENT_OTHER_RACE",
    "PERCENT_MULTIRACIAL", "PERCENT_NONCITIZEN", "MALE_0_TO_17", "FEMALE_0_TO_17",
    "MALE_18_TO_29", "FEMALE_18_TO_29", "FEMALE_30_TO_49", "MALE_OVER_50", "FEMALE_OVER_50",
)
CASE_LAGS = tuple(COUNTY.lags_of("CCT", skip=(21,)))
DEATH_LAGS = tuple(COUNTY.lags_of("DT", skip=(21,)))
FORMULAS = {
    "cases": ("CONFIRMED_CASES", (*CASE_LAGS, "E_TOTPOP", *STATIC_TERMS)),
    "deaths": ("DEATHS", (*CASE_LAGS, *DEATH_LAGS, "E_TOTPOP", *STATIC_TERMS)),
    "percapita": ("CC_PER_CAPITA", (*CASE_LAGS, *STATIC_TERMS)),
    "forecast_error": ("error", ("E_TOTPOP", *STATIC_TERMS)),
}

# The columns of the published summaries and of the correlation matrix.
BAND_NAMES = tuple(f"{s}_{b}" for b in AGE_BANDS for s in SEXES)
DESCRIBED = {
    "measures": ("CONFIRMED_CASES", "DEATHS"),
    "bands": BAND_NAMES,
    "shares": (
        "PERCENT_WHITE", "PERCENT_HISPANIC", "PERCENT_BLACK", "PERCENT_ASIAN",
        "PERCENT_AMERINDIAN", "PERCENT_OTHER_RACE", "PERCENT_MULTIRACIAL",
    ),
    "covariates": (
        "E_TOTPOP", "EP_PCI", "EP_POV", "EP_CROWD", "EP_DISABL", "EP_GROUPQ", "EP_MINRTY",
        "EP_NOHSDP", "EP_UNINSUR", "RPL_THEMES", "PERCENT_DEM", "PERCENT_REP",
        "PERCENT_NONCITIZEN", "DIABETES_RATE", "SMOKING_RATE",
    ),
}
CORRELATED = (
    "CONFIRMED_CASES", "DEATHS", "E_TOTPOP", "MEDIAN_INCOME", "EP_CROWD", "EP_DISABL",
    "EP_GROUPQ", "EP_MINRTY", "EP_NOHSDP", "EP_UNINSUR", "RPL_THEMES", "PERCENT_DEM",
    "PERCENT_REP", "DIABETES_RATE", "SMOKING_RATE", *DESCRIBED["shares"], "PERCENT_NONCITIZEN",
    *BAND_NAMES,
)

# The scaler leaves these out: keys, and two shares used unscaled.
UNSCALED = ("DATE", "COUNTY", "FIPS", "ds", "PERCENT_REP", "PERCENT_WHITE")
SCALED = tuple(c for c in COUNTY.log_columns() if c not in UNSCALED)
