"""Scalar parsers for league feeds; bad input gives null, not an error, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def snake_case(c) -> Column:
    """Underscore at each lower-to-upper step; blanks and dashes become underscores; lower case."""
    return F.lower(F.translate(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1_$2"), " -", "__"))


def clock_seconds(c) -> Column:
    """Seconds left of ``PT11M23.00S`` (prefix match; bare ``PT`` is 0) or ``11:23``; else null."""
    x = F.trim(_col(c))
    iso = r"^PT(?:(\d+)M)?(?:([\d.]+)S)?"
    minutes = F.coalesce(_part(x, iso, 1).try_cast("double"), F.lit(0.0))
    seconds = F.coalesce(_part(x, iso, 2).try_cast("double"), F.lit(0.0))
    colon = r"^(\d+):(\d+(?:\.\d+)?)$"
    return F.when(x.rlike("^PT"), minutes * 60 + seconds).when(x.rlike(colon), _part(x, colon, 1).cast("double") * 60 + _part(x, colon, 2).cast("double"))


def minutes_to_seconds(c) -> Column:
    """Whole seconds played: null unknown, blank 0, anchored ISO duration with a component (halves to even), ``MM:SS``."""
    x = F.trim(_col(c))
    iso = r"^PT(?=\d)(?:(\d+)M)?(?:(\d+(?:\.\d*)?)S)?$"
    total = F.coalesce(_part(x, iso, 1).cast("double"), F.lit(0.0)) * 60 + F.coalesce(_part(x, iso, 2).cast("double"), F.lit(0.0))
    colon = r"^(\d+):(\d+)$"
    return F.when(x == "", 0).when(x.rlike(iso), F.bround(total, 0).cast("int")).when(x.rlike(colon), (_part(x, colon, 1).cast("int") * 60 + _part(x, colon, 2).cast("int")))


def safe_int(c) -> Column:
    return F.trim(_col(c).cast("string")).try_cast("int")


def is_substitution(c) -> Column:
    return F.coalesce(F.lower(_col(c)).contains("substitution"), F.lit(False))


def sub_names(c) -> tuple[Column, Column]:
    """Incoming and outgoing name of ``SUB: X FOR Y``."""
    pattern = "^SUB: (.+) FOR (.+)$"
    return _part(_col(c), pattern, 1), _part(_col(c), pattern, 2)


#: fixed value: ids in this range are teams, which some feeds put in player slots
TEAM_IDS = (1610612737, 1610612766)


def has_reliable_player(name, team_id, action, person_id) -> Column:
    """Whether an action's person id can be trusted to be a player on a team."""
    return F.coalesce(
        (F.trim(F.coalesce(_col(name), F.lit(""))) != "") & (F.coalesce(_col(team_id), F.lit(0)) != 0) & (F.lower(F.coalesce(_col(action), F.lit(""))) != "instant replay") & ~_col(person_id).between(*TEAM_IDS),
        F.lit(False),
    )


def period_seconds(period) -> Column:
    """720 in the four quarters, 300 in overtime."""
    return F.when(_col(period) <= 4, 720.0).otherwise(300.0)


def elapsed(period, clock_left) -> Column:
    """Seconds since the period began; 0 for an unknown clock."""
    return F.coalesce(period_seconds(period) - _col(clock_left), F.lit(0.0))


def short_hash(*parts, digits: int = 16) -> Column:
    """First ``digits`` of the SHA-1 of the parts joined by ``|``."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, digits)


def request_key(endpoint: str, params: dict) -> str:
    """Cache key of a request: SHA-256 (24 digits) of its sorted JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"endpoint": endpoint, "params": params}, sort_keys=True, default=str).encode()).hexdigest()[:24]


def looks_empty(payload) -> Column:
    """A JSON payload without data: result sets that are all without rows, or only falsy top-level values."""
    p = _col(payload)
    sets = F.from_json(p, "struct<resultSets:array<struct<rowSet:array<string>>>>")["resultSets"]
    values = F.map_values(F.from_json(p, "map<string,string>"))
    falsy = F.forall(F.coalesce(values, F.array()), lambda v: F.coalesce(v, F.lit("null")).isin("null", "", "0", "0.0", "false", "[]", "{}"))
    return F.when(sets.isNotNull(), F.forall(sets, lambda s: F.coalesce(F.size(s["rowSet"]), F.lit(0)) <= 0)).otherwise(falsy)
