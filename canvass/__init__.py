"""canvass: lead search, dedup and enrichment as Spark DataFrame jobs.

Public API (every function is lazy and returns DataFrames unless noted)::

    from canvass import (get_spark, read_leads_csv, write_leads, prepare_for_enrich,
                         enrich, enrich_reviews, enrich_web, search, search_places,
                         search_many, within_radius, append_new, append_summary,
                         generate, with_prompts, preview, resume, run, stream_append)
"""

from .operators.append import append_new, append_summary
from .operators.fuzzy import fuzzy_lookup
from .operators.generate import generate, with_prompts
from .operators.merge import merge_back, preview, result_metrics, resume
from .operators.search import search_many, search_places, within_radius, within_radius_many
from .plans.enrich import enrich, enrich_reviews, prepare_for_enrich
from .plans.jobs import enrich_file, enrich_web_file, generate_file, search_file
from .plans.run import run, run_preview, run_rest
from .plans.search import search
from .plans.web import enrich_web
from .session import checkpoint_dir, get_spark
from .sources.leads_io import (append_dataset, read_leads_csv, with_row_id, write_enriched,
                               write_leads)
from .sources.responses import collect_pages, flatten_responses, harmonise_places, lookup_outcome
from .streaming.append import stream_append

__all__ = [
    "append_dataset", "append_new", "append_summary", "checkpoint_dir", "collect_pages",
    "enrich", "enrich_file", "enrich_reviews", "enrich_web", "enrich_web_file", "generate_file",
    "search_file", "flatten_responses", "fuzzy_lookup", "generate",
    "get_spark", "harmonise_places", "lookup_outcome", "merge_back", "prepare_for_enrich",
    "preview", "read_leads_csv", "result_metrics", "resume", "run", "run_preview", "run_rest",
    "search", "search_many", "search_places", "stream_append", "with_prompts", "with_row_id",
    "within_radius", "within_radius_many", "write_enriched", "write_leads",
]
