from panelwright.functions.columns import (
    band_share,
    date_key,
    ln_or_null,
    ratio,
    round_ln,
)

__all__ = ["band_share", "date_key", "ln_or_null", "ratio", "round_ln"]
