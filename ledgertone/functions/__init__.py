from .arrow import gestalt_ratio, levenshtein_ratio
from .automaton import osa_within
from .curves import (
    log_fraction,
    log_frequency,
    split_fields,
    suggest_tags,
    summarize_metrics,
)
from .describe import describe_change
from .drivers import classify_driver, driver_parts, parse_driver, unknown_driver_tokens
from .numbers import (
    coerce_int,
    exact_mean,
    import_price,
    num_expr,
    price_tier,
    py_float,
    round_to_5,
    tier_basis,
    valid_year,
)
from .search import search
from .tags import fix_tier_tags, tag_conflicts
from .text import (
    alpha_core,
    brand_fold,
    build_id,
    entry_label,
    fold_ascii,
    guard_paths,
    is_curve_file,
    nonlatin_digest,
    normalize_component,
    normalize_path,
    safe_path,
    sanitize_filename,
    target_path,
)

__all__ = [n for n in dir() if not n.startswith("_")]
