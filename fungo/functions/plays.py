"""Play-by-play event text: runs, outs, base states."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F


def main_event(event: Column) -> Column:
    """Event without runner advances and modifiers."""
    return F.trim(F.substring_index(F.substring_index(event, ".", 1), "/", 1))


def runs_on_play(event: Column) -> Column:
    """Runners reaching home, the batter of a home run included.

    A home run scores the batter even where the text lists only the other runners.
    """
    advances = F.regexp_count(event, F.lit("-H"))
    batter = (main_event(event).startswith("HR") & ~event.contains("B-H")).cast("int")
    return (advances + batter).cast("int")


def outs_on_play(event: Column) -> Column:
    """Outs made on a play, by ordered rules.

    Passed balls, balks and wild pitches come before the one-letter out codes, so
    that PB is not taken for a pop-out.
    """
    primary = F.substring_index(event, ".", 1)
    ev = main_event(event)
    begins = lambda *heads: functools.reduce(lambda x, y: x | y, [ev.startswith(h) for h in heads])
    out = (F.when(event.isNull() | (event == "") | (event == "NP"), 0)
           .when(primary.contains("TP"), 3)
           .when(primary.contains("DP"), 2)
           .when(begins("CS") | (begins("PO") & ~ev.contains("E")), 1)
           .when(begins("PB", "PO", "FC", "FLE"), 0)
           .when(begins("K", "!K", "G", "F", "L", "P"), 1)
           .when(ev.rlike("^[0-9]"), 1)
           .otherwise(0))
    return out.cast("int")


def base_state_key(outs: Column, first: Column, second: Column, third: Column) -> Column:
    """``outs_mask`` with a bit per occupied base."""
    mask = first.cast("int") + second.cast("int") * 2 + third.cast("int") * 4
    return F.concat_ws("_", F.least(outs, F.lit(3)).cast("string"), mask.cast("string"))
