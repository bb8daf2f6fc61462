"""Times, names, generated texts and rendering as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capitalised words that are no names.
NOT_NAMES = (
    "Why", "Are", "Both", "Very", "Come", "That", "This", "What", "Daughter", "Ciao", "Ok", "Okay", "Yes", "No", "Please", "Sorry", "Hey", "Oh", "Ah", "Wait",
    "Look", "Listen", "Fine", "Good", "Stop", "Run", "Go", "Help", "Now", "Just", "Then", "Sir", "Miss", "Mister", "Mr", "Mrs", "Dr", "Phone", "Dear", "Shut",
)
#: The names of scenes.
SCENES = (
    "kitchen", "living room", "bedroom", "office", "hallway", "street", "village", "forest", "beach", "outdoor field",
    "vehicle interior", "rooftop", "restaurant", "stage/studio", "unknown",
)
#: Marks of a generated text that isn't a description.
FILLERS = (
    r"(?i)let\s+me\s+know\s+if",
    r"(?i)i('| a)ll\s+be\s+happy\s+to",
    r"(?im)^(answer|here\s+is|here'?s)\b",
    r"(?m)^-{2,}\s*$",
    r"(?i)as\s+an\s+ai",
    r"(?i)i\s+(can'?t|cannot|am\s+unable)",
    r"(?i)please\s+note\s+that",
    r"(?i)based\s+on\s+(the\s+)?visible\s+elements",
    r"(?i)does\s+not\s+include\s+any\s+assumptions",
    r"(?m)^\s*\d+\.\s",
    r"(?i)<end\s+of[^>]*>",
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clock(ms) -> Column:
    """HH:MM:SS, truncated; hours have no upper bound."""
    s = F.floor(_c(ms) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def srt_time(ms) -> Column:
    """HH:MM:SS,mmm, truncated to whole milliseconds."""
    m = F.floor(_c(ms))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000)


def parse_time(x) -> Column:
    """Milliseconds of HH:MM:SS.mmm or MM:SS.mmm (comma or point); 0 for anything else."""
    parts = F.split(F.regexp_replace(F.trim(_c(x)), ",", "."), ":")
    n = F.size(parts)
    number = lambda i: F.expr("0.0") if i is None else F.get(parts, F.lit(i)).try_cast("double")
    ms = F.when(n == 3, (number(0) * 3600 + number(1) * 60 + number(2)) * 1000).when(n == 2, (number(0) * 60 + number(1)) * 1000)
    return F.coalesce(ms, F.lit(0.0))


def vocative(text) -> Column:
    """STRUCT<name, confidence> of the name that a subtitle line calls out; NULL if none.

    A line that is nothing but a name counts high, a name after a comma at the end medium.
    """
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    whole = F.regexp_extract(t, r"^([A-Z][a-zA-Z]{1,20})[!.]?$", 1)
    after = F.regexp_extract(t, r",\s*([A-Z][a-zA-Z]{1,20})[?.!]?\s*$", 1)
    name = lambda x: (x != "") & ~x.isin(*NOT_NAMES)
    return F.when(name(whole), F.struct(whole.alias("name"), F.lit("high").alias("confidence"))).when(
        name(after), F.struct(after.alias("name"), F.lit("medium").alias("confidence"))
    )


def accepted_text(raw, fallback) -> Column:
    """A generated text if it passes the gates (length, filler, lines), else ``fallback``."""
    t = F.regexp_replace(_c(raw), r"^\s+|\s+$", "")
    bad = (F.length(t) < 5) | (F.length(t) - F.length(F.replace(t, F.lit("\n"))) > 4)
    for pattern in FILLERS:
        bad |= t.rlike(pattern)
    return F.when(t.isNull() | bad, _c(fallback)).otherwise(t)


def vocabulary_match(answer, labels: list[str]) -> Column:
    """The first label that the answer contains or that contains the answer; unknown if none or empty."""
    a = F.lower(F.trim(_c(answer)))
    hits = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(a, x) | F.contains(x, a))
    return F.coalesce(F.when(a != "", F.get(hits, F.lit(0))), F.lit("unknown"))


def first_integer(text) -> Column:
    return F.coalesce(F.regexp_extract(_c(text), r"(\d+)", 1).try_cast("int"), F.lit(0))


def prompt_context(scene, action, dialogue, most: int = 80) -> Column:
    """What a captioner is told of a second: its scene and action, and the start of its dialogue if there is any."""
    d = _c(dialogue)
    short = F.when(F.length(d) > most, F.concat(F.left(d, F.lit(most)), F.lit("…"))).otherwise(d)
    return F.concat_ws(
        "; ",
        F.concat(F.lit("scene: "), F.coalesce(_c(scene), F.lit("unknown"))),
        F.concat(F.lit("action: "), F.coalesce(_c(action), F.lit("unknown"))),
        F.when(F.length(d) > 0, F.concat(F.lit('dialogue: "'), short, F.lit('"'))),
    )


def capitalised(x) -> Column:
    """The first letter upper, all others lower case."""
    return F.concat(F.upper(F.left(_c(x), F.lit(1))), F.lower(F.substr(_c(x), F.lit(2))))


def people_shown(labels, most) -> Column:
    n = _c(most)
    counted = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("Person "), i.cast("string"))), ", ")
    return F.when(F.size(_c(labels)) > 0, F.array_join(_c(labels), ", ")).when(n > 0, counted).otherwise("None")


def event_block(number, start_ms, end_ms, kind, people, place, summary) -> Column:
    """One event of the readable log."""
    return F.concat(
        F.format_string("Event %03d\n", _c(number)),
        *[clock(start_ms), F.lit(" -> "), clock(end_ms)],
        *[F.lit("\nType: "), _c(kind), F.lit("\nCharacters: "), _c(people)],
        *[F.lit("\nLocation: "), capitalised(F.coalesce(F.nullif(_c(place), F.lit("")), F.lit("Unknown")))],
        *[F.lit("\nSummary: "), F.coalesce(F.nullif(_c(summary), F.lit("")), F.lit("(no summary)"))],
    )


def relabelled(text, names) -> Column:
    """``text`` with every key of the map ``names`` replaced by its value, in the keys' order."""
    return F.aggregate(F.array_sort(F.map_entries(_c(names))), _c(text), lambda t, e: F.replace(t, e["key"], e["value"]))
