"""Grounded release answers and ask-log analytics on Spark."""

from .operators.events import answers_to_events, last_prompts, normalize_events, retain_last
from .operators.lookups import (
    attach_releases,
    dated_patch,
    latest_per_product,
    product_release,
    vendor_patch,
)
from .operators.percentiles import approximate_percentiles, exact_percentiles
from .operators.releases import patch_feed, search_releases, vendor_feed
from .operators.summary import SummaryFilter
from .operators.vendors import resolve_vendor, vendors_in_names
from .plans.answer import Options, answer_questions
from .plans.component import component_snapshot
from .plans.display import display_answers
from .plans.explain import explain_matches, explain_questions
from .plans.summary import build_summary

__all__ = [
    "Options",
    "SummaryFilter",
    "answer_questions",
    "answers_to_events",
    "approximate_percentiles",
    "attach_releases",
    "build_summary",
    "component_snapshot",
    "dated_patch",
    "display_answers",
    "exact_percentiles",
    "explain_matches",
    "explain_questions",
    "last_prompts",
    "latest_per_product",
    "normalize_events",
    "patch_feed",
    "product_release",
    "resolve_vendor",
    "retain_last",
    "search_releases",
    "vendor_feed",
    "vendor_patch",
    "vendors_in_names",
]
