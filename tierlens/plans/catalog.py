"""All queries, loaded."""

from . import clean, curate, evaluate, files, marts, profile, prompts, scoring, spans  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
