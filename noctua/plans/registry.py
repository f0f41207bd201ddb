"""Every registered query of the library's own operators, with SQL that gives the same rows."""

from noctua.plans import extra, files, frames, images, normalization, sky, statistics, stores, streams  # noqa: F401
from noctua.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
