"""Frames of two engines as comparable rows."""


def plain(v):
    """A value as text: numbers of any type alike, NaN (a null of pandas) as null."""
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return "None"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
        return repr([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, (int, float)) else repr(v)


def rows_of(pdf):
    """A frame's rows, sorted, by columns in the order of their names."""
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False))
