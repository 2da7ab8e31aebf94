"""Scans of microdata and lookup tables, label binding and result sinks."""

from surveyloom.sources.scan import bind_labels, design_roster, scan_lookup, scan_microdata
from surveyloom.sources.sink import write_by_site, write_results

__all__ = ["bind_labels", "design_roster", "scan_lookup", "scan_microdata", "write_by_site", "write_results"]
