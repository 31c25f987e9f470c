"""Every query of the library by name, with its SQL counterpart."""

from __future__ import annotations

from . import cache, chunks, codecs, compare, formats, library, overlay, policy, profile, ranges, scalars, store, streams, trace, trees, trials, validity  # noqa: F401
from .register import ORACLES, QUERIES  # noqa: F401
