"""Writers of report results."""
