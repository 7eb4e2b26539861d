"""Order-insensitive comparison of result rows."""


import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):  # pandas makes floats of whole numbers beside nulls
        return int(v) if v.is_integer() else round(v, 6)
    return v.item() if hasattr(v, "item") else v


def same_rows(got, expected):
    """Both are pandas frames: equal columns and equal bags of rows."""
    assert sorted(got.columns) == sorted(expected.columns)
    names = sorted(got.columns)
    bag = lambda df: sorted(map(repr, (tuple(plain(v) for v in row) for row in df[names].itertuples(index=False, name=None))))
    assert bag(got) == bag(expected)
