"""Spark-native engine for sparse, irregular measurement series."""

import os

# linear algebra in Python workers must not start threads of its own beside the tasks
os.environ.setdefault("OMP_NUM_THREADS", "1")
