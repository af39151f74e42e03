"""Comparison of a Spark frame with a DuckDB relation."""

from __future__ import annotations

import pytest


def canonical(rows, columns):
    """Rows in an order and form that two engines share."""

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return float(f"{v:.11g}")
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        return v

    return sorted((tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr)


def assert_same_rows(frame, relation):
    columns = frame.columns
    own = canonical([tuple(r) for r in frame.collect()], columns)
    theirs = canonical(relation.fetchall(), [d[0] for d in relation.description])
    assert sorted(columns) == sorted(d[0] for d in relation.description)
    assert len(own) == len(theirs)
    for a, b in zip(own, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and float(x) == pytest.approx(float(y), rel=1e-9, abs=1e-9)), (a, b)
