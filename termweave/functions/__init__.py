"""Column functions: text preparation, release and form, strengths, prompts."""

from .forms import dosage_form, release, us_style
from .prompts import answered_ids, file_prompt, prompt
from .strength import components, features, similarity, strength_stats, strengths, without
from .text import brand_score, brands, normalized, prepared_query, sanitized, spaced_strengths, usan_names

__all__ = ["answered_ids", "brand_score", "brands", "components", "dosage_form", "features", "file_prompt", "normalized", "prepared_query", "prompt", "release", "sanitized", "similarity", "spaced_strengths", "strength_stats", "strengths", "us_style", "usan_names", "without"]
