"""tabweave: PySpark-native tabular synthesis, fidelity analytics and training-data operators."""

import os

# Spark tasks are the parallelism; threads inside BLAS would compete with them.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
