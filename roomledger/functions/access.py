"""Column mask and row filter as column functions.

Open-source Spark has no group-membership function, so the caller's groups are an argument.
"""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomledger.schemas import (
    ANALYST, CITY_HOTEL, CITY_MANAGER, ENGINEER, MASK, RESORT_HOTEL, RESORT_MANAGER,
)


def mask_pii(col, groups: Iterable[str]) -> Column:
    """The value for engineers, the mask (also over NULL) for everyone else."""
    value = F.col(col) if isinstance(col, str) else col
    return value if ENGINEER in set(groups) else F.lit(MASK)


def hotel_row_filter(col, groups: Iterable[str]) -> Column:
    """True for the rows the groups may see; several groups add up, no group sees nothing."""
    groups = set(groups)
    if groups & {ENGINEER, ANALYST}:
        return F.lit(True)
    hotel = F.col(col) if isinstance(col, str) else col
    managed = {CITY_MANAGER: CITY_HOTEL, RESORT_MANAGER: RESORT_HOTEL}
    visible = [name for group, name in managed.items() if group in groups]
    return hotel.isin(visible) if visible else F.lit(False)
