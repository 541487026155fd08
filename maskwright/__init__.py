"""Finding, scoring, masking and pseudonymising sensitive values, and profiling tables, on Spark.

The names below are imported on first use, so that Python workers that only
need one operator load no more than that.
"""

from importlib import import_module

_FROM = {
    "config": ("CustomPattern", "MaskingConfig", "RenderConfig"),
    "functions.hashing": ("pseudonym", "register_hash"),
    "functions.masks": ("mask", "register_mask"),
    "functions.registry": ("REGISTRY", "column_type", "is_sensitive_column"),
    "functions.validators": ("register_format", "register_validator", "validate"),
    "operators.copying": ("copy_with_context",),
    "operators.detect": ("candidates", "counts_by_type", "detect"),
    "operators.location": ("sibling_ordinals", "with_context", "xml_tags"),
    "operators.mask_text": ("mask_cdata", "mask_text", "with_masked_text"),
    "operators.render": ("detailed_report", "render", "smart_report", "table_report"),
    "operators.tabular": ("classify_columns", "detect_delimiters", "mask_columns", "mask_delimited", "profile"),
}
_HOME = {name: module for module, names in _FROM.items() for name in names}

__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
