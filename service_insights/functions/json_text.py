"""Text and JSON helpers as Columns: answer cleaning, slugs, config JSON."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas

# A run of blanks is tried at its first one only: tried at each of them, it costs the square of its length.
_END = r"(?<!\s)\s++\z"


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^\s++|{_END}", "")


def strip_fence(text: Column) -> Column:
    """Remove a markdown code fence around an answer.

    Trim; if it opens with three backticks drop the first line (or only the
    backticks when there is no newline), then a closing fence; trim again.
    NULL gives ''.

    A text from brace to brace has nothing to remove and is not searched. Each
    step uses the one before once: ``from_json`` evaluates its input as it is
    written, and a step used twice would run twice."""
    t = F.coalesce(text, F.lit(""))
    t0 = _strip_ws(t)
    t1 = F.regexp_replace(t0, r"^(?:[^\n]*+\n|```)", "")
    t2 = F.regexp_replace(F.regexp_replace(t1, _END, ""), r"```\z", "")
    return (F.when(t.startswith("{") & t.endswith("}"), t)
            .when(t.rlike(r"^\s*+```"), _strip_ws(t2))
            .otherwise(t0))


def slug(name: Column) -> Column:
    """Table-name slug: runs of [^a-zA-Z0-9_] -> '_', strip '_', lower; '' -> 'config'."""
    s = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("config"))


def output_prefix(name: Column, config_id: Column) -> Column:
    """Slug plus the whole config id, so two configs whose names slug alike
    do not overwrite each other's tables."""
    return F.concat(slug(name), F.lit("_"), F.coalesce(config_id, F.lit("")))


def config_components(components_json: Column) -> Column:
    """Parse a config's component list; bad or NULL JSON gives []."""
    return F.coalesce(F.from_json(components_json, schemas.CONFIG_COMPONENTS),
                      F.array().cast(schemas.CONFIG_COMPONENTS))

