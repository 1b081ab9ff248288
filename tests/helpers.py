import math

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if not isinstance(v, (list, tuple, dict)) and pd.isna(v):  # NaN, NaT, pd.NA
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
        return int(v)
    if isinstance(v, float):
        return round(v, 6)
    return v


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
