"""Chat formatting: typed content parts flattened into one marked string, with attachments and a loss mask.

DataFrame functions only. A turn is ``<turn>role``, a new line, the content, a new line and ``</turn>``. Inside content
and roles a backslash is doubled and a control string's ``<`` gets one before it, so no text can end or open a turn
and every text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"(\\|</?turn>|<media )"
_OPEN, _CLOSE = "<turn>", "\n</turn>\n"
#: What one unit of an attachment (a 28-pixel patch, a second, a page) takes in tokens; fixed values of this template.
TOKENS_PER_UNIT = {"image": 1.0, "audio": 25.0, "document": 256.0}
CHARS_PER_TOKEN = 4.0
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|<)", "$1")


def _escape_line(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_line(role: Column) -> Column:
    plain = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\<"), F.lit("<"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("double").alias("units")))


def _tokens(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, per_unit in TOKENS_PER_UNIT.items():
        rate = F.when(part.kind == kind, F.lit(per_unit)).otherwise(rate)
    return F.when(part.kind == "text", F.ceil(F.length(F.coalesce(part.text, F.lit(""))) / CHARS_PER_TOKEN)).otherwise(F.ceil(F.coalesce(part.units, F.lit(0.0)) * rate))


def _visit(part: Column, place: Column) -> Column:
    """A text part gives its escaped text, any other kind a placeholder that names its kind and place in the turn."""
    placeholder = F.concat(F.lit("<media "), F.regexp_replace(F.coalesce(part.kind, F.lit("unknown")), "[^A-Za-z0-9_]", "_"), F.lit(" "), place.cast("string"), F.lit(">"))
    return F.when(part.kind == "text", escape(F.coalesce(part.text, F.lit("")))).otherwise(placeholder)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each conversation.

    Takes conv_id, turn, role and either parts (an array of ``PART``) or text; other columns are ignored. Returns
    conv_id, n_turns, formatted, loss (for each turn in order, whether training learns its content: assistant turns),
    attachments (turn, part, kind, ref, tokens of every part that isn't text, in order) and n_tokens, with attachments
    expanded. Turns are ordered by turn, then role and content; null turns come first; a null role, text or part is
    empty; repeated rows stay; a null conv_id is a conversation of its own. A conversation is the unit of the output,
    so one conversation must fit a task; turns are formatted before they are gathered.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_parts(F.col("text"))
    parts = F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    others = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), p.kind.alias("kind"), p.ref.alias("ref"), _tokens(p).alias("tokens"))), lambda a: ~a.kind.eqNullSafe(F.lit("text")))
    shaped = own.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(_OPEN), _escape_line(F.col("role")), F.lit("\n"), F.array_join(F.transform("parts", _visit), ""), F.lit(_CLOSE)).alias("shaped"),
        others.alias("others"),
        F.aggregate(F.transform("parts", _tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
    )
    gathered = shaped.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "shaped", "others", "tokens"))).alias("all"))
    placed = F.flatten(F.transform("all", lambda t: F.transform(t.others, lambda a: F.struct(t.turn.alias("turn"), a.part.alias("part"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))))
    return gathered.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all.shaped"), "").alias("formatted"),
        F.transform("all", lambda t: t.role == "assistant").alias("loss"),
        placed.alias("attachments"),
        F.aggregate("all.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
    )


def parse_turns(formatted: DataFrame) -> DataFrame:
    """Read ``format_turns`` back: conv_id, formatted, turns (an array of role, content, unescaped, and loss), and what
    there is of attachments and n_tokens."""
    split = F.split("formatted", r"(?<!\\)<turn>")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)  # nothing lies before the first turn

    def turn(piece: Column, i: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        content = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(_CLOSE))
        return F.struct(_unescape_line(role).alias("role"), unescape(content).alias("content"), F.get("loss", i).alias("loss"))

    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), *(c for c in ("attachments", "n_tokens") if c in formatted.columns))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from the formatted strings alone, and how many attachments and tokens there are."""
    read = parse_turns(formatted)
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t.loss), lambda t: t.content), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.content, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_tokens",
    )
