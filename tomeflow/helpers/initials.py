"""A helper in the form that ``Helpers.load`` reads: the capitals of a name."""

import pandas as pd

RETURN_TYPE = "string"


def helper(names: pd.Series) -> pd.Series:
    return names.str.replace(r"[^A-Z]", "", regex=True)
