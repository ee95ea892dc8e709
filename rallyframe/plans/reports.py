"""Serving chains: filtered points -> status mask -> gates -> metric -> joined and ordered report.

Each takes a scored log and one ``Filters`` and returns a short report with a ``place``.
"""

from pyspark.sql import functions as F

from rallyframe.operators import filters as flt
from rallyframe.operators import metrics as mx
from rallyframe.session import written

#: All that the pressure reports read; a log cut down to them is cheaper to store.
PRESSURE_COLUMNS = [
    "match_id", "year", "tour", "tournament_name", "player1", "player2", "server_name", "returner_name", "server_win", "returner_win", "importance",
]


def chosen_points(log, filters):
    """Points of the chosen years, tour and tournament, players without the wanted status masked."""
    return flt.mask_by_status(filters.apply(log), filters.status)


def consistency_tab(log, filters, min_points=0):
    """Consistency index and points added per player, most points added first."""
    report = mx.consistency_and_clutch(chosen_points(log, filters), min_points)
    return mx.ranked(report, F.col("expected_points_added").desc_nulls_last(), F.col("player"))


def pressure_points(log, filters, min_points=0, percent=25, sketches=None):
    """Points of players with enough points as player 1, flagged by the threshold of what is left.

    ``sketches`` of the whole log (by year, tour and tournament) are merged for the choice and bracket
    the threshold, so that it takes one scan. The log is read once: the choice, its masked points and those
    that pass the gate are each stored, since the next step scans them several times.
    """
    chosen = written(filters.apply(log), "chosen")
    masked = written(flt.mask_by_status(chosen, filters.status), "masked") if filters.status != flt.ALL else chosen
    kept = written(flt.with_player1_total(masked, min_points).drop("total_points"), "gated")
    return flt.with_high_pressure(kept, percent, sketches=None if sketches is None else filters.apply(sketches))


def pressure_tab(log, filters, min_points=0, min_ranking_points=200, min_share_points=0, percent=25, sketches=None):
    """Win rates under pressure, best clutch delta first.

    The threshold is taken after the gate on points, over the points that passed it.
    """
    points = pressure_points(log.select(*[c for c in PRESSURE_COLUMNS if c in log.columns]), filters, min_points, percent, sketches)
    report = mx.pressure_report(points, min_points, min_ranking_points, min_share_points)
    return mx.ranked(report, F.col("clutch_delta").desc_nulls_last(), F.col("player"))


def results_tab(log, filters, n=10, sets_needed=None):
    """The most unlikely wins of the chosen points, least likely first."""
    top = mx.top_upsets(chosen_points(log, filters), n, sets_needed)
    return mx.ranked(top, F.col("winner_prob_before").asc_nulls_last(), F.col("match_id"))
