"""Every registered query of the reference's operators, with its SQL."""

from __future__ import annotations

from tabweave.plans import q_metrics, q_models, q_process, q_sources, q_transforms

MODULES = (q_transforms, q_sources, q_metrics, q_process, q_models)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "train_test_distance"
