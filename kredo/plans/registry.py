"""Imports every query module so that its ``register`` calls run."""

from kredo.plans import features  # noqa: F401
from kredo.plans.common import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
from kredo.plans import logs  # noqa: F401,E402
from kredo.plans import evaluation  # noqa: F401,E402
from kredo.plans import drift  # noqa: F401,E402
from kredo.plans import prep  # noqa: F401,E402
from kredo.plans import ops  # noqa: F401,E402
from kredo.plans import scoring  # noqa: F401,E402
from kredo.plans import streams  # noqa: F401,E402
from kredo.plans import io  # noqa: F401,E402
from kredo.plans import tables  # noqa: F401,E402
from kredo.plans import payloads  # noqa: F401,E402
from kredo.plans import catalog  # noqa: F401,E402
