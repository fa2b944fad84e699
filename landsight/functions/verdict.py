"""Model reply -> risk verdict, one native column expression.

Rule (per reply):

1. strip the reply (Python ``str.strip``);
2. if it contains a code fence (three backticks), keep the piece between the
   first two fences and drop a leading ``json`` tag;
3. if that text is exactly one JSON object, ``danger`` is its ``danger`` value
   as text, upper-cased (missing -> ``N``, JSON null -> ``NONE``), and
   ``justification`` its ``justification`` (missing -> the stripped reply;
   JSON null -> NULL; non-text values as JSON text);
4. otherwise ``danger`` is ``Y`` when the lower-cased reply contains one of
   the danger stems, else ``N``, and ``justification`` is the stripped reply.

Strict JSON in Spark: ``from_json`` tolerates trailing text and single quotes,
so the text is parsed twice -- wrapped as ``[text]`` (exactly one element, an
object) and as ``{"r": text}`` (rejects a trailing ``]``) -- with single quotes
disallowed.  Duplicate keys keep their last value (struct parse), and key
presence is read from the map parse.  Replies that are JSON but not objects
(``[1]``, ``5``, ``null``) fall back to step 4 instead of failing the job.
A NULL reply (the model call failed) gives a NULL verdict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import strip_text

# The code fence, its language tag, and the danger stems.
FENCE = "```"
FENCE_TAG = "json"
DANGER_STEMS = ["risk", "danger", "deforest", "erosion", "pollut", "degrad", "threat", "alarm", "concern"]

_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unfence(raw) -> Column:
    """the stripped reply, or the piece between the first two fences with a
    leading ``json`` tag removed."""
    r = strip_text(_c(raw))
    inner = F.get(F.split(r, FENCE, -1), 1)
    inner = F.regexp_replace(inner, f"^{FENCE_TAG}", "")
    return F.when(F.instr(r, FENCE) > 0, inner).otherwise(r)


def keyword_danger(raw) -> Column:
    """``Y`` when the lower-cased reply contains a danger stem, else ``N``."""
    pattern = "|".join(DANGER_STEMS)
    return F.when(F.lower(_c(raw)).rlike(pattern), F.lit("Y")).otherwise(F.lit("N"))


def parse_verdict(raw) -> Column:
    """``struct(danger string, justification string)`` from a raw reply."""
    stripped = strip_text(_c(raw))
    text = unfence(raw)
    as_array = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _JSON_OPTIONS
    )
    as_object = F.from_json(
        F.concat(F.lit('{"r":'), text, F.lit("}")), "map<string,map<string,string>>", _JSON_OPTIONS
    )
    fields = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        "array<struct<danger:string,justification:string>>",
        _JSON_OPTIONS,
    )
    obj = F.get(as_array, 0)
    valid = (
        text.isNotNull()
        & (F.size(as_array) == 1)
        & obj.isNotNull()
        & F.element_at(as_object, F.lit("r")).isNotNull()
    )
    rec = F.get(fields, 0)
    danger = (
        F.when(~F.map_contains_key(obj, "danger"), F.lit("N"))
        .when(rec["danger"].isNull(), F.lit("NONE"))
        .otherwise(F.upper(rec["danger"]))
    )
    justification = F.when(~F.map_contains_key(obj, "justification"), stripped).otherwise(
        rec["justification"]
    )
    ok = F.coalesce(valid, F.lit(False))
    missing = stripped.isNull()  # no reply at all (failed call): no verdict
    return F.struct(
        F.when(missing, F.lit(None).cast("string")).when(ok, danger).otherwise(keyword_danger(stripped))
        .alias("danger"),
        F.when(ok, justification).otherwise(stripped).alias("justification"),
    )
