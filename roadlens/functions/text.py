"""String, array-of-number and date Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only blanks."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def tag_pattern(tag: str) -> str:
    return f"(?s)<{tag}>(.*?)</{tag}>"


def extract_tag(text, tag: str) -> Column:
    """trimmed content of the first ``<tag>..</tag>`` (DOTALL); NULL when absent."""
    t = _c(text)
    return F.when(t.rlike(tag_pattern(tag)), strip(F.regexp_extract(t, tag_pattern(tag), 1)))


def extract_all_tags(text, tag: str) -> Column:
    """every ``<tag>`` content, trimmed; empty array when none."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(tag_pattern(tag)), 1), strip)


def parse_values(raw) -> Column:
    """comma list of numbers; blanks dropped; NULL when any token is not a number.

    The source returns ``([], False)`` for a bad token; here the whole list is NULL, and
    ``values_found`` tells found-but-invalid from absent.
    """
    toks = F.filter(F.transform(F.split(_c(raw), ","), strip), lambda x: x != "")
    vals = F.transform(toks, lambda x: x.try_cast("double"))
    return F.when(_c(raw).isNull(), F.lit(None)).when(F.exists(vals, lambda v: v.isNull()), F.lit(None)).otherwise(vals)


def extract_values(text, tag: str) -> Column:
    """F3 on a tag: list of doubles or NULL (tag absent or a bad token)."""
    return parse_values(extract_tag(text, tag))


# ---- fixed values (must equal the studied code base): number pattern of the numeric embedding
NUMBER_PATTERN = r"[-+]?[0-9]*\.?[0-9]+"
# ------------------------------------------------------------------------------


def numeric_embedding(text) -> Column:
    """every number in the text, in order, as ARRAY<DOUBLE>."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(NUMBER_PATTERN), 0), lambda x: x.cast("double"))


def kv_text(pairs: list[tuple[str, Column]]) -> Column:
    """``"k: v, k: v"`` from named values (dict order kept)."""
    parts = [F.concat(F.lit(f"{k}: "), _c(v).cast("string")) for k, v in pairs]
    return F.concat_ws(", ", *parts)


def duration_text(seconds) -> Column:
    """``1d2h3m4s``; a unit is shown when its count > 0, seconds always."""
    s = F.floor(_c(seconds)).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), s % 60

    def part(n, u):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise(F.lit(""))

    return F.concat(part(d, "d"), part(h, "h"), part(m, "m"), r.cast("string"), F.lit("s"))


def start_time_from_name(name) -> Column:
    """drive start time from a ``yyyy-MM-dd-HH-mm-ss_...`` name."""
    return F.to_timestamp(F.substring(_c(name), 1, 19), "yyyy-MM-dd-HH-mm-ss")


def vehicle_parts(vid) -> dict[str, Column]:
    """``"{n}_{controller}_{kind}#{tag}..."`` -> id_num, controller, kind, tags."""
    v = _c(vid)
    head = F.split(v, "#").getItem(0)
    parts = F.split(head, "_")
    return {
        "id_num": parts.getItem(0).try_cast("int"),
        "controller": parts.getItem(1),
        "kind": parts.getItem(2),
        "tags": F.slice(F.split(v, "#"), 2, 1 << 20),
    }


def leaderboard_id(vid) -> Column:
    """The whole id behind the prefix of its kind - a tagged sensor, a human, an AV;
    the recorded leader counts as human. Null stays null, an unknown kind is an error."""
    v = _c(vid)
    kind = (F.when(v.contains("#sensor"), "sensor_").when(v.contains("human"), "human_").when(v.contains("av"), "av_")
            .when(v.contains("trajectory"), "human_"))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(kind.isNotNull(), F.concat(kind, v)).otherwise(
        F.raise_error(F.concat(F.lit("unknown vehicle kind: "), v)))


def pad_to(arr, k: int, fill=-1.0) -> Column:
    """first k elements, padded with ``fill`` to length k."""
    a = F.slice(_c(arr), 1, k)
    return F.concat(a, F.array_repeat(F.lit(fill).cast("double"), F.greatest(F.lit(k) - F.size(a), F.lit(0))))


# ---- fixed values (must equal the studied code base): platoon string grammar ----
PLATOON_GROUP = r"\(([a-z0-9\s\*#]+)\)\*([0-9]+)"
PLATOON_TOKEN = r"\([a-z0-9\s\*#]+\)\*[0-9]+|[a-z]+(?:#[a-z]+)*(?:\*[0-9]+)?"
VEHICLE_TOKEN = r"[a-z]+(?:#[a-z]+)*(?:\*[0-9]+)?"
# ------------------------------------------------------------------------------


def expand_platoon(spec) -> Column:
    """platoon string -> ordered ARRAY<STRUCT<kind, tags>> with one element per
    vehicle: ``(sub)*n`` repeats sub n times, ``veh#tag*n`` repeats a vehicle n times."""
    toks = F.regexp_extract_all(_c(spec), F.lit(PLATOON_TOKEN), 0)

    def unfold(tok):
        # a group's vehicles are read once, then repeated
        body = F.regexp_extract(tok, PLATOON_GROUP, 1)
        n = F.regexp_extract(tok, PLATOON_GROUP, 2).cast("int")
        group = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(VEHICLE_TOKEN), 0), vehicles))
        return F.when(tok.startswith("("), F.flatten(F.array_repeat(group, n))).otherwise(vehicles(tok))

    def vehicles(tok):
        kind = F.regexp_extract(tok, r"^([a-z]+)", 1)
        tags = F.filter(F.split(F.regexp_extract(tok, r"^[a-z]+((?:#[a-z]+)*)", 1), "#"), lambda t: t != "")
        cnt = F.coalesce(F.regexp_extract(tok, r"\*([0-9]+)$", 1).try_cast("int"), F.lit(1))
        return F.array_repeat(F.struct(kind.alias("kind"), tags.alias("tags")), cnt)

    return F.flatten(F.transform(toks, unfold))


def merge_config(defaults: Column, overrides: Column) -> Column:
    """defaults overridden by the config (last wins) without relying on the
    session's map-key dedup policy."""
    keep = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(keep, overrides)


def markdown_rows(rows: Column, cols: list[str]) -> Column:
    """'| a | b |' per row of an ordered ARRAY<STRUCT>, newline joined."""
    return F.array_join(F.transform(rows, lambda r: F.concat(
        F.lit("| "), F.concat_ws(" | ", *[r[c].cast("string") for c in cols]), F.lit(" |"))), "\n")


def frame_text(rows: Column, cols: dict[str, str], max_rows: int | None = None) -> Column:
    """a window (ordered ARRAY<STRUCT>) as text for a prompt: shape, columns with their types, and a table. ``cols``: name -> type
    as shown; values are cast as they are (round before). Longer windows keep the first and last ``max_rows // 2`` rows."""
    if max_rows is not None:
        half = max_rows // 2
        rows = F.when(F.size(rows) > max_rows, F.concat(F.slice(rows, 1, half), F.slice(rows, F.size(rows) - half + 1, half))).otherwise(rows)
    names = list(cols)
    head = "\n\nColumns:\n" + "".join(f"- {c} ({kind})\n" for c, kind in cols.items()) + "\nData:\n"
    head += "| " + " | ".join(names) + " |\n| " + " | ".join("-" * len(c) for c in names) + " |\n"
    shape = F.concat(F.lit("DataFrame with shape: "), F.size(rows).cast("string"), F.lit(f" rows \u00d7 {len(names)} columns"))
    return F.concat(shape, F.lit(head), markdown_rows(rows, names), F.lit("\n"))


def documents_text(docs: Column, fields: list[str]) -> Column:
    """retrieved documents (ordered ARRAY<STRUCT>) as the prompt has them, numbered from 0; none: a sentence that says so."""
    one = lambda d, i: F.concat(F.lit("Situation n:"), i.cast("string"), F.lit(" \n"), kv_text([(f, d[f]) for f in fields]), F.lit("\n\n"))
    return F.when(F.size(docs) > 0, F.array_join(F.transform(docs, one), "")).otherwise(F.lit("No similar situations found in the database."))
