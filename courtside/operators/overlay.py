"""Ordered roster transactions over an immutable contract snapshot.

Every step touches the rows of one slug, so a transaction list becomes steps (slug, seq, ...) and each slug, with those
it is renamed to or from, folds on its own, in parallel, in the order of ``seq``. Trades become one step for each leg.
"""

from __future__ import annotations

import functools

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTRACT_YEAR
from ..session import plain_unions
from ..tables import durable, forget

KINDS = ("sign", "waive", "trade", "amend")
STEP = "seq long, leg int, kind string, bbref_slug string, player string, team string, cap_hit long, guaranteed long, dead_money boolean, field string, value string, note string, as_of string"
_COLUMNS = [c.split()[0] for c in CONTRACT_YEAR.split(", ")]


def new_slug(player: str) -> str:
    return "__new__" + player.replace(" ", "_").lower()


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of single-key maps to steps. Other shapes and kinds are errors."""
    with open(path) as f:
        doc = yaml.safe_load(f) or []
    items = doc.get("transactions", []) if isinstance(doc, dict) else doc
    rows = []
    for seq, item in enumerate(items):
        if not isinstance(item, dict) or len(item) != 1 or next(iter(item)) not in KINDS:
            raise ValueError(f"transaction {seq}: one of {KINDS} is expected")
        kind, b = next(iter(item.items()))
        base = {"seq": seq, "leg": 0, "kind": kind, "note": b.get("note", ""), "as_of": str(b["as_of"]) if b.get("as_of") else None}
        if kind == "trade":
            rows += [base | {"leg": k, "bbref_slug": leg["slug"], "team": leg["to_team"]} for k, leg in enumerate(b["legs"])]
        elif kind == "sign":
            rows.append(base | {"bbref_slug": b.get("slug") or new_slug(b["player"]), "player": b["player"], "team": b["team"], "cap_hit": int(b["cap_hit"]), "guaranteed": int(b["guaranteed"])})
        elif kind == "waive":
            rows.append(base | {"bbref_slug": b["slug"], "team": b["team"], "dead_money": bool(b.get("stretch_dead_money", False))})
        else:
            if b["field"] not in _COLUMNS:
                raise ValueError(f"amend: unknown field {b['field']!r}")
            rows.append(base | {"bbref_slug": b["slug"], "field": b["field"], "value": None if b["value"] is None else str(b["value"])})
    names = [c.split()[0] for c in STEP.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], STEP)


def _cast(field: str, value):
    kind = dict(c.split() for c in CONTRACT_YEAR.split(", "))[field]
    if value is None or kind == "string":
        return value
    return str(value).lower() == "true" if kind == "boolean" else int(value)


def _place(row: dict) -> tuple:
    """Rows of a slug go by contract id, then by what else tells them apart; nulls first."""
    return tuple((row[c] is not None, row[c]) for c in ("contract_id", "bbref_slug", "cap_hit", "guaranteed", "team_abbrev"))


def _fold(season: str):
    """The fold of one group of slugs that renames connect: each step finds the rows that bear its slug by then."""

    def run(key, base: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        plain = base[_COLUMNS].astype(object)
        rows = sorted(plain.where(plain.notna(), None).to_dict("records"), key=_place)
        warnings: list[tuple] = []
        for s in steps.sort_values(["seq", "leg"]).itertuples():
            slug = s.bbref_slug
            own, rest = [r for r in rows if r["bbref_slug"] == slug], [r for r in rows if r["bbref_slug"] != slug]
            warn = functools.partial(lambda step, text: warnings.append((step.seq, step.leg, text)), s)
            if s.kind == "sign":
                if own:
                    warn(f"{slug} was under contract with {own[0]['team_abbrev']}: the {s.team} deal takes its place")
                new = slug.startswith("__new__")
                own = [dict.fromkeys(_COLUMNS) | {"contract_id": f"override:{s.player if new else slug}", "season": season, "bbref_slug": slug, "player": s.player, "team_abbrev": s.team, "season_index": 1, "cap_hit": int(s.cap_hit), "guaranteed": int(s.guaranteed), "is_guaranteed": s.guaranteed >= s.cap_hit, "needs_review": False}]
            elif not own:
                warn(f"no row of {slug} to {s.kind}")
            elif s.kind == "waive":
                first = own[0]
                if first["team_abbrev"] != s.team:
                    warn(f"{slug} is waived by {s.team} but held by {first['team_abbrev']}, whose row goes")
                own = [first | {"cap_hit": first["guaranteed"], "needs_review": True, "review_reason": "waived_dead_money", "contract_id": f"dead:{slug}"}] if s.dead_money and first["guaranteed"] > 0 else []
            elif s.kind == "trade":
                own = [r | {"team_abbrev": s.team} for r in own]
            else:
                own = [r | {s.field: _cast(s.field, s.value)} for r in own]
            rows = sorted(rest + own, key=_place)
        out = [r | {"warn_seq": None, "warn_leg": None, "warning": None} for r in rows] + [dict.fromkeys(_COLUMNS) | {"warn_seq": a, "warn_leg": b, "warning": w} for a, b, w in warnings]
        return pd.DataFrame(out, columns=[*_COLUMNS, "warn_seq", "warn_leg", "warning"])

    return run


def _roots(steps: DataFrame) -> DataFrame | None:
    """(slug, root) of the slugs that renames connect, root being the least of them; None without a rename.

    Each round a slug takes the least root among its neighbours' and its own, then its root's root, so chains of
    renames halve; rounds go on until no root changes.
    """
    renames = steps.filter("kind = 'amend' and field = 'bbref_slug' and value is not null and value <> bbref_slug").select(F.col("bbref_slug").alias("a"), F.col("value").alias("b")).distinct()
    if renames.isEmpty():
        return None
    both = durable(plain_unions(renames).unionByName(renames.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "renames")
    now = durable(both.select(F.col("a").alias("slug"), F.col("a").alias("root")).distinct(), "roots")
    while True:
        near = both.join(now.select(F.col("slug").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("slug")).agg(F.min("other").alias("other"))
        least = now.join(near, "slug").select("slug", F.least("root", "other").alias("root"), F.col("root").alias("before"))
        jump = now.select(F.col("slug").alias("root"), F.col("root").alias("further"))
        after = durable(least.join(jump, "root").select("slug", F.least("root", "further").alias("root"), "before"), "roots")
        changed = not after.filter("root <> before").isEmpty()
        forget(now)
        now = after
        if not changed:
            forget(both)
            return now.select("slug", "root")


def apply_transactions(years: DataFrame, steps: DataFrame, season: str) -> tuple[DataFrame, DataFrame]:
    """(contract-years of the season after all steps, warnings in order of the steps).

    Steps of a slug are folded in order. An amended slug is followed: slugs that renames connect, whichever way
    round, are one fold, in which later steps find rows by the slug they bear by then. Slugs that no step names never
    leave the JVM; the others meet their steps co-grouped. Rows of one slug go by contract id (``_place``).
    """
    base = years.filter(F.col("season") == season).select(_COLUMNS)
    roots = _roots(steps)
    if roots is None:
        rooted = lambda d: d.withColumn("_root", F.col("bbref_slug"))
    else:
        known = roots.withColumnRenamed("slug", "bbref_slug")
        rooted = lambda d: d.join(known, "bbref_slug", "left").withColumn("_root", F.coalesce("root", "bbref_slug")).drop("root")
    base, steps = rooted(base), rooted(steps)
    touched = steps.select("_root").distinct()
    still = base.join(touched, "_root", "left_anti").select(_COLUMNS)
    moved = base.join(touched, "_root", "left_semi")
    folded = moved.groupBy("_root").cogroup(steps.groupBy("_root")).applyInPandas(_fold(season), CONTRACT_YEAR + ", warn_seq long, warn_leg int, warning string")
    return plain_unions(still).unionByName(folded.filter("warning is null").select(_COLUMNS)), folded.filter("warning is not null").select("warn_seq", "warn_leg", "warning").orderBy("warn_seq", "warn_leg")
