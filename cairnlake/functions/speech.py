"""What is said, by fixed phrases: importance, urgency, standing instructions, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.scoring import clamp
from cairnlake.functions.text import fingerprint, squeezed

# Fixed values.
LASTING = (
    "remember", "don't forget", "important", "note that", "my name is", "i prefer", "i like", "i don't like", "always", "never",
    "make sure", "keep in mind", "i promise", "promise me", "i will always", "count on me", "i commit", "you have my word", "i swear",
)
AWAITED = (
    "my interview", "my flight", "my appointment", "my exam", "my presentation", "my surgery", "the deadline", "due on",
    "tomorrow i", "next week i", "i'm nervous about", "i'm dreading", "wish me luck",
)
URGENT = "(urgent|emergency|asap|deadline|critical|important|blocked|stuck)"
HARMFUL = "(hurt|danger|unsafe|crash|hospital|lawyer|legal|doctor|medical|suicide|self-harm)"
PERSONAL = "(remember|forget|consent|permission|private|password|secret|delete|wipe|replace)"
EDGE, END = r"(^|[\s\p{Punct}])", r"([\s\p{Punct}]|$)"
STANDING = "(always|never|from now on|going forward|make sure|remember to|do not ever|don't ever|must)"
WHENEVER = "(when|whenever|every time)"
DEEDS = "(use|prefer|route|call|avoid|send|write|read|reply|create|update|delete|notify|ask|check|analyze|extract|ingest|surface|respond|run|keep|show|tell|include|exclude|cite|confirm|verify|save|store)"
PREFIXED = r"(?i)^\s*(search_document|search_query|clustering|classification)\s*:"


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def turn_importance(asked: Column, answered: Column, baseline: Column) -> Column:
    """Importance of a turn: its baseline, raised by length and by what is said."""
    asked, answered = F.coalesce(asked, F.lit("")), F.coalesce(answered, F.lit(""))
    both = F.lower(F.concat(asked, F.lit("\n"), answered))
    long = (F.length(asked) > 200) | (F.length(answered) > 500)
    floor = lambda c, x: F.when(c, x).otherwise(0.0)
    return clamp(F.greatest(F.coalesce(baseline, F.lit(0.5)), floor(long, 0.7), floor(_says(both, LASTING), 0.8), floor(_says(both, AWAITED), 0.65)), 0.15, 1.0)


def salience(message: Column, attachments: Column) -> Column:
    """How much a message asks for attention, 0 to 1."""
    said = F.lower(F.coalesce(message, F.lit("")))
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    length = F.when(F.length(said) >= 1200, 0.2).when(F.length(said) >= 400, 0.1).otherwise(0.0)
    parts = length + plus(F.contains(said, F.lit("?")), 0.05) + plus(said.rlike(URGENT), 0.3) + plus(said.rlike(HARMFUL), 0.45) + plus(said.rlike(PERSONAL), 0.2)
    return clamp(parts + plus(F.coalesce(attachments, F.lit(0)) > 0, 0.15))


def depth(salience: Column) -> Column:
    return F.when(salience >= 0.65, "deep").when(salience < 0.2, "skim").otherwise("normal")


def standing_instruction(text: Column) -> Column:
    """A key for a text that gives a standing instruction, else null: it names a deed
    and says always or when; a question needs the former."""
    said = squeezed(text)
    lower = F.lower(said)
    strong, loose = lower.rlike(EDGE + STANDING + END), lower.rlike(EDGE + WHENEVER + END)
    told = lower.rlike(EDGE + DEEDS + END) & (strong | loose) & ~(said.endswith("?") & ~strong)
    return F.when(told, F.concat(F.lit("operator.standing."), F.left(F.sha2(fingerprint(said), 256), F.lit(24))))


def embedding_prefix(text: Column, prefix: str = "search_document") -> Column:
    """The text with the prefix its embedding needs, unless it has one."""
    named = prefix.strip(" ")
    return F.when(text.rlike(PREFIXED), F.ltrim(text)).otherwise(F.concat(F.lit(f"{named}: "), text) if named else text)


def address(channel: Column, given: Column) -> Column:
    """An address without case and outer blanks; for email what stands in angle brackets."""
    bare = F.lower(F.btrim(F.coalesce(given, F.lit("")), F.lit(" ")))
    inside = F.regexp_extract(bare, "<([^>]+)>", 1)
    return F.when((F.lower(F.coalesce(channel, F.lit(""))) == "email") & (inside != ""), inside).otherwise(bare)


def weekday(name: Column) -> Column:
    """ISO day of the week (1 is Monday) of a name or number; null for anything else."""
    given = F.lower(F.btrim(name, F.lit(" ")))
    known = {"mon": 1, "monday": 1, "tue": 2, "tues": 2, "tuesday": 2, "wed": 3, "weds": 3, "wednesday": 3, "thu": 4, "thur": 4, "thurs": 4, "thursday": 4, "fri": 5, "friday": 5, "sat": 6, "saturday": 6, "sun": 7, "sunday": 7}
    number = given.try_cast("int")
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), given)
    return F.when(number == 0, 7).when(number.between(1, 7), number).otherwise(named)
