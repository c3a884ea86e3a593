"""Registered queries over the stand-in views."""


def load_registry():
    from opinara.plans import (  # noqa: F401
        q_aspects,
        q_clusters,
        q_features,
        q_models,
        q_relational,
        q_scalar,
        q_sources,
        q_textflow,
        q_vectors,
    )
    from opinara.plans.registry import REGISTRY

    return REGISTRY
