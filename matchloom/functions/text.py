"""Labels, clocks, and parsing of free-form or JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom.functions.common import switch

# --- fixed values: ordinal words ---
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth",
)
VERDICTS = ("GOAL", "SAVE", "MISS", "PASS")


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60)).cast("bigint"))


def clock_from_frame(frame: Column, fps: float) -> Column:
    return clock(frame / F.lit(fps))


def number_name(number: Column, name: Column, fallback: Column) -> Column:
    n = F.concat(F.lit("#"), number.cast("string"))
    named = name.isNotNull() & (name != "")
    return F.when(named & number.isNotNull(), F.concat_ws(" ", n, name)).when(named, name).when(number.isNotNull(), n).otherwise(fallback)


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def event_text(team: Column, kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.replace(team, F.lit("_"), F.lit(" "))), F.lit("] "),
                    F.upper(F.replace(kind, F.lit("_"), F.lit(" "))))


def score_line(a: Column, sa: Column, sb: Column, b: Column) -> Column:
    return F.format_string("%s %d - %d %s", a, sa, sb, b)


def ordinal(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in ORDINALS])
    return F.when(n.between(1, len(ORDINALS)), F.get(words, (n - 1).cast("int"))).otherwise(
        F.concat(F.lit("no. "), n.cast("string"))
    )


def bgr_hex(b: Column, g: Column, r: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)])


def actor_number(label: Column) -> Column:
    n = F.regexp_extract(label, r"#(\d+)", 1)
    return F.when(n != "", n.cast("bigint"))


def jersey_number(raw: Column, conf: Column, min_conf: float = 0.55) -> Column:
    """1..99 from a read of one or two digits with enough confidence, else null."""
    n = raw.try_cast("bigint")
    return F.when(raw.rlike(r"^\d{1,2}$") & n.between(1, 99) & (conf >= min_conf), n)


def json_span(s: Column) -> Column:
    """Text from the first { to the last }, null without one."""
    m = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(m != "", m)


def verdict(reply: Column) -> Column:
    """struct<outcome, confidence, reason> from JSON in a reply, else by keyword, else '?'."""
    obj = F.from_json(json_span(reply), "outcome string, confidence double, reason string", {"mode": "PERMISSIVE"})
    ok = obj.isNotNull() & (obj["outcome"].isNotNull() | obj["confidence"].isNotNull() | obj["reason"].isNotNull())
    up = F.upper(reply)
    key = switch([(up.contains(k), k) for k in VERDICTS], "?")
    return F.when(
        ok,
        F.struct(
            F.upper(F.coalesce(obj["outcome"], F.lit("?"))).alias("outcome"),
            F.coalesce(obj["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(obj["reason"], F.lit("")).alias("reason"),
        ),
    ).otherwise(
        F.struct(
            key.alias("outcome"), F.when(key == "?", F.lit(0.0)).otherwise(F.lit(0.5)).alias("confidence"),
            reply.alias("reason"),
        )
    )


def strip_fence(s: Column) -> Column:
    """Text inside a leading code fence (and its closing fence), trimmed."""
    t = F.regexp_replace(s, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```$", "")
    return F.regexp_replace(F.when(t.startswith("```"), body).otherwise(t), r"^\s+|\s+$", "")


def insight(reply: Column, first: str = "internal_reasoning", second: str = "tactical_insight") -> Column:
    """struct<reasoning, insight>: two JSON keys, or the whole text as the insight."""
    s = strip_fence(reply)
    obj = F.from_json(json_span(s), f"{first} string, {second} string")
    ok = obj[first].isNotNull() | obj[second].isNotNull()
    return F.when(ok, F.struct(F.trim(obj[first]).alias("reasoning"), F.trim(obj[second]).alias("insight"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("reasoning"), F.nullif(s, F.lit("")).alias("insight"))
    )


def compact_json(cols: list[str]) -> Column:
    """Row as compact JSON without null or empty fields."""
    kept = [F.nullif(F.col(c), F.lit("")).alias(c) if t else F.col(c) for c, t in cols]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "true"})
