"""All registered checks, in the order of the inventory."""

from importlib import import_module

MODULES = ("core_checks", "analysis_checks", "enrich_checks", "filter_checks", "profile_checks", "report_checks", "dashboard_checks", "tactical_checks", "signal_checks", "source_checks")


def all_checks():
    return [import_module(f"checks.{name}").C for name in MODULES]
