from panelwright.sources.scan import assert_unique, nan_to_null, scan_panel, unique_rows
from panelwright.sources.standin import panel_nation, panel_supplier, series_event_type

__all__ = [
    "assert_unique",
    "nan_to_null",
    "panel_nation",
    "panel_supplier",
    "scan_panel",
    "series_event_type",
    "unique_rows",
]
