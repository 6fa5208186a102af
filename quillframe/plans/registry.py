"""All queries of this package, by name."""

from __future__ import annotations

from quillframe.plans import code as _code  # noqa: F401  (adds to the same tables)
from quillframe.plans import fixtures as _fixtures  # noqa: F401
from quillframe.plans import more as _more  # noqa: F401
from quillframe.plans import queries as _q
from quillframe.plans import wide as _wide  # noqa: F401


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
