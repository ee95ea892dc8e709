"""Facts read from a match id: ``YYYY-slam-GRNN``, ``YYYY-slam-MSRNN`` or ``YYYY-slam-WSRNN``."""

from pyspark.sql import functions as F

from rallyframe.constants import TOURNAMENT_NAMES


def literal_map(mapping):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def tour(match_id="match_id", variant="prefix"):
    """``ATP`` / ``WTA`` from a match id.

    ``prefix`` looks for MS/WS and then at the first character of the third part (the
    default everywhere), ``suffix`` looks for MS/WS and then at the fourth character from
    the end, ``digits_first`` tests that character first and MS/WS at a fixed place.
    """
    c = F.col(match_id)
    fourth_last = F.substring(c, -4, 1)
    men, women = c.like("%-MS%"), c.like("%-WS%")
    if variant == "digits_first":
        mark = F.substring(c, -5, 2)
        return (
            F.when(fourth_last == "1", "ATP").when(fourth_last == "2", "WTA")
            .when(mark == "MS", "ATP").when(mark == "WS", "WTA").otherwise("UNKNOWN")
        )
    if variant == "prefix":
        digit = F.substring(F.split_part(c, F.lit("-"), F.lit(3)), 1, 1)
    elif variant == "suffix":
        digit = fourth_last
    else:
        raise ValueError(f"unknown tour variant: {variant}")
    long_enough = F.length(c) >= 4
    return (
        F.when(men, "ATP").when(women, "WTA")
        .when(long_enough & (digit == "1"), "ATP")
        .when(long_enough & (digit == "2"), "WTA")
        .otherwise("Unknown")
    )


def tournament_name(code="tournament"):
    """Display name of a tournament code, or the code itself."""
    return F.coalesce(literal_map(TOURNAMENT_NAMES)[F.col(code)], F.col(code))


def _draw_marks(match_id):
    c = F.col(match_id)
    # FIXED pattern values: MS/WS draws first, else the last four digits.
    by_letters = r"-(MS|WS)(\d)\d*$"
    by_digits = r"(\d)(\d)\d\d$"
    return (
        c.rlike(by_letters), F.regexp_extract(c, by_letters, 1), F.regexp_extract(c, by_letters, 2),
        c.rlike(by_digits), F.regexp_extract(c, by_digits, 1), F.regexp_extract(c, by_digits, 2),
    )


def best_of(match_id="match_id"):
    """5 for men, 3 for women, null when the id fits no pattern."""
    letters, draw, _, digits, gender, _ = _draw_marks(match_id)
    return F.when(letters, F.when(draw == "MS", 5).otherwise(3)).when(
        digits, F.when(gender == "1", 5).otherwise(3)
    )


def round_number(match_id="match_id"):
    """Round digit, null when the id fits no pattern."""
    letters, _, first, digits, _, second = _draw_marks(match_id)
    return F.when(letters, first.cast("int")).when(digits, second.cast("int"))


def is_best_of_five(tour_column="tour"):
    return F.coalesce(F.col(tour_column).isin("ATP", "Both"), F.lit(False))


def id_parts(match_id="match_id"):
    """year, tourney_code and match_num of an id; the last part keeps further dashes."""
    parts = F.split(F.col(match_id), "-", 3)
    names = ["id_year", "tourney_code", "match_num"]
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}
