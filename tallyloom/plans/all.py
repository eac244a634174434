"""Imports every query module so that the registry is complete."""

from tallyloom.plans import customer  # noqa: F401
from tallyloom.plans import graph  # noqa: F401
from tallyloom.plans import evaluation, profiling, sampling  # noqa: F401
from tallyloom.plans import retrieval  # noqa: F401
from tallyloom.plans import models, sources  # noqa: F401
from tallyloom.plans import flows  # noqa: F401
