from . import features, modelling, sampling, sources, statistics  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
