"""Review analytics on Spark: the functions most programs start from.

Names are looked up on first use, so that a worker which only needs one module of the
package does not load all of it.
"""

from importlib import import_module

_WHERE = {
    "clean_text": ("opinara.functions.text", "clean_spacing"),
    "preprocess_text": ("opinara.functions.text", "preprocess"),
    "sentiment_model": ("opinara.operators.models", "sentiment_model"),
    "sentiment_scores": ("opinara.operators.models", "sentiment_scores"),
    "process_texts": ("opinara.operators.aspects", "mentions"),
    "aspect_importance": ("opinara.operators.aspects", "summary"),
    "agreed_phrase": ("opinara.operators.aspects", "agreed_phrase"),
    "key_thought": ("opinara.operators.models", "extractive_summary"),
    "analyze_reviews": ("opinara.operators.aspects", "analyse"),
    "local_session": ("opinara.session", "local_session"),
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, function = _WHERE[name]
    return getattr(import_module(module), function)
