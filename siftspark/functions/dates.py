"""RFC 3339 timestamps as epoch milliseconds."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:\d{2})?$"
_PATTERN = re.compile(_SHAPE, re.ASCII)


def epoch_millis(text: str) -> int | None:
    """Milliseconds since 1970; a missing offset is UTC, fractions are cut, second 60 counts as 59."""
    m = _PATTERN.match(text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x) for x in m.groups()[:6])
    if not 1 <= month <= 12 or year < 1 or not 1 <= day <= calendar.monthrange(year, month)[1] or hour > 23 or minute > 59 or second > 60:
        return None
    offset = 0
    if (zone := m[8]) and zone not in "Zz":
        if int(zone[1:3]) > 23 or int(zone[4:]) > 59:
            return None
        offset = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:]))
    millis = int((m[7] or "0")[:3].ljust(3, "0"))
    return (calendar.timegm((year, month, day, hour, minute, min(second, 59))) - offset * 60) * 1000 + millis


def millis(text: Column) -> Column:
    """The same as a column; null where the text is no timestamp."""
    part = lambda i: F.regexp_extract(text, _SHAPE, i)
    second = F.when(part(6) == "60", F.lit("59")).otherwise(part(6))
    zone = F.when((part(8) == "") | (F.upper(part(8)) == "Z"), F.lit("+00:00")).otherwise(part(8))
    ok = text.rlike(_SHAPE) & (F.substring(zone, 2, 2) < "24") & (F.substring(zone, 5, 2) < "60") & (part(4) < "24") & (part(1) > "0000")
    local = F.try_to_timestamp(F.concat_ws("", part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), second, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    fraction = F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int")
    return F.when(ok, F.unix_millis(local) - minutes * 60_000 + F.coalesce(fraction, F.lit(0)))
