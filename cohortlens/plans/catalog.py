"""All registered queries; importing a section registers its entries."""

import importlib

from .registry import REGISTRY

SECTIONS = ("tables", "columns", "geometry", "splits", "guards", "baselines", "metrics",
            "resampling", "inference", "association", "ranking", "theory", "reports")
for _section in SECTIONS:
    try:
        importlib.import_module(f"cohortlens.plans.{_section}")
    except ModuleNotFoundError as e:
        if e.name != f"cohortlens.plans.{_section}":
            raise
