"""Wrapping of labels into lines of a fixed width, as a fold over their words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_WIDTH = 15
PATH_WIDTH = 40

# Places at which a text may be cut: around spaces, after a hyphen within a word
# of letters, and before and after a dash of several hyphens between words.
_LETTER = r"[^\d\W]"
_BEFORE_DASH = r"[\w!\"'&.,?]"
BREAKS = (
    r"(?U)(?<= )(?=[^ ])|(?<=[^ ])(?= )"
    rf"|(?<={_LETTER}{{2}}-)(?={_LETTER}-?{_LETTER})|(?<={_LETTER}-{_LETTER}-)(?={_LETTER}-?{_LETTER})"
    rf"|(?<={_BEFORE_DASH})(?=-{{2,}}\w)|(?<={_BEFORE_DASH}-{{2,100}})(?=\w)"
)


def _state(lines: Column, line: Column) -> Column:
    return F.struct(lines.alias("lines"), line.alias("line"))


def _ended(state: Column) -> Column:
    """The lines with the open one, spaces at its end dropped; a line of spaces alone is none."""
    line = F.rtrim(state["line"])
    return F.when(line == "", state["lines"]).otherwise(F.concat(state["lines"], F.array(line)))


def _first_piece(word: Column, room: Column) -> Column:
    """How much of a word that is too long for any line goes into the room left: up to its last hyphen there."""
    head = F.substring(word, F.lit(1), room)
    hyphen = room - F.length(F.regexp_extract(head, r"[^-]*$", 0))
    named = F.regexp_replace(F.substring(word, F.lit(1), hyphen - 1), "-", "") != ""
    return F.when((F.length(word) > room) & (hyphen > 1) & named, hyphen).otherwise(room)


def wrapped(text: Column, width: int = LABEL_WIDTH) -> Column:
    """``text`` in lines of at most ``width`` characters, joined by line ends.

    Lines are filled greedily. White space at the start of a later line and at
    the end of a line goes, but for a full line that a word too long for any
    follows; such a word is cut where the line ends, or behind its last hyphen before. Every white space character counts
    as one space, a tab too. Null stays null, and a blank text gives the empty one.
    """
    if width < 1:
        raise ValueError("a line needs a width of at least 1")
    wide = F.lit(width)
    words = F.split(F.regexp_replace(text, r"[\t\n\x0B\f\r]", " "), BREAKS)

    def placed(state: Column, word: Column) -> Column:
        """A word no longer than a line: on the open line, or on a new one."""
        blank = F.trim(word) == ""
        fits = F.length(state["line"]) + F.length(word) <= wide
        leading = blank & (state["line"] == "") & (F.size(state["lines"]) > 0)
        # Spaces at the very start fill whole lines that are dropped; the rest of them stays.
        opening = F.substring(word, F.lit(1), (F.length(word) - 1) % wide + 1)
        new = _state(
            _ended(state),
            F.when(~blank, word).when(F.size(_ended(state)) > 0, F.lit("")).otherwise(opening),
        )
        return F.when(leading, state).when(fits, _state(state["lines"], F.concat(state["line"], word))).otherwise(new)

    def cut(state: Column, word: Column) -> Column:
        """A word longer than a line, piece by piece."""

        def piece(s: Column, _: Column) -> Column:
            rest = s["rest"]
            room = wide - F.length(s["line"])
            end = F.when(F.length(rest) > wide, _first_piece(rest, room)).otherwise(F.length(rest))
            fits = (F.length(rest) > wide) | (F.length(rest) <= room)
            taken = _state(s["lines"], F.concat(s["line"], F.substring(rest, F.lit(1), end)))
            full = F.struct(
                F.concat(taken["lines"], F.array(taken["line"])).alias("lines"), F.lit("").alias("line"),
                F.substring(rest, end + 1, F.length(rest)).alias("rest"),
            )
            last = F.struct(taken["lines"].alias("lines"), taken["line"].alias("line"), F.lit("").alias("rest"))
            moved = F.struct(_ended(s).alias("lines"), rest.alias("line"), F.lit("").alias("rest"))
            return F.when(rest == "", s).when(~fits, moved).when(F.length(rest) > wide, full).otherwise(last)

        start = F.struct(state["lines"].alias("lines"), state["line"].alias("line"), word.alias("rest"))
        done = F.aggregate(F.sequence(F.lit(0), F.length(word)), start, piece)
        return _state(done["lines"], done["line"])

    def step(state: Column, word: Column) -> Column:
        long = (F.length(word) > wide) & (F.trim(word) != "")
        return F.when(long, cut(state, word)).otherwise(placed(state, word))

    start = _state(F.array().cast("array<string>"), F.lit(""))
    return F.array_join(F.aggregate(words, start, step, _ended), "\n")
