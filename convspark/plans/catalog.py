"""Import every plan module so its queries register themselves."""

from . import judge, profiles, requests, runs, sft, splits, streams, text, tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
