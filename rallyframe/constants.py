"""Schemas and fixed values shared by every module."""

# ---- fixed values -------------------------------------------------------
SCORE_POINTS = {"0": 0, "15": 1, "30": 2, "40": 3, "AD": 4}
ROUND_STAKES = {1: 10, 2: 45, 3: 90, 4: 180, 5: 360, 6: 720, 7: 1200, 8: 2000}
TOURNAMENT_NAMES = {
    "ausopen": "Australian Open",
    "frenchopen": "French Open",
    "wimbledon": "Wimbledon",
    "usopen": "US Open",
}
DEFAULT_SERVE_PCT = 0.62
DEFAULT_RETURN_PCT = 0.38
UNKNOWN = "UNKNOWN"
IOC_TO_ISO2 = {
    "SUI": "CH", "DEN": "DK", "GER": "DE", "BLR": "BY", "POL": "PL", "TUN": "TN", "UKR": "UA",
    "BUL": "BG", "SRB": "RS", "KAZ": "KZ", "RSA": "ZA", "RUS": "RU", "TPE": "TW", "PUR": "PR",
    "ESA": "SV", "INA": "ID", "VAN": "VU", "NMI": "MP", "POC": "XK", "IRI": "IR", "SWE": "SE",
    "CHI": "CL", "AUT": "AT", "NED": "NL", "CRO": "HR", "KOR": "KR", "POR": "PT", "CHN": "CN",
}
WINNER_NAME_FIXES = {"C. O'connell": "C. O'Connell"}
SETS_NEEDED = {"ATP": 3, "All": 3, "WTA": 2}

# ---- keys ---------------------------------------------------------------
GAME = ["match_id", "set_no", "game_no"]
SET = ["match_id", "set_no"]

# ---- schemas, as DDL ----------------------------------------------------

RAW_MATCHES = (
    "match_id string, year int, slam string, match_num string, player1 string, player2 string, "
    "status string, winner string, event_name string, round string, court_name string, "
    "court_id string, player1id string, player2id string, nation1 string, nation2 string"
)
# Numeric columns of the raw log arrive dirty, so they are read as text and cast by the cleaner.
RAW_POINTS = (
    "match_id string, ElapsedTime string, SetNo string, GameNo string, PointNumber string, "
    "PointWinner string, PointServer string, P1Score string, P2Score string, P1GamesWon string, "
    "P2GamesWon string, SetWinner string, P1PointsWon string, P2PointsWon string"
)
PLAYER_COUNTRIES = "player string, country string"
_SET_GAMES = ", ".join(f"set{s}_p{p} double" for s in range(1, 6) for p in (1, 2))
PREPARED_LOG = (
    "match_id string, SetNo int, GameNo int, PointNumber int, PointWinner int, PointServer int, P1Score string, "
    "P2Score string, tournament string, year int, player1 string, player2 string, P1_Sets_Won int, P2_Sets_Won int, "
    "P1_Games_Won int, P2_Games_Won int, score string, P1Score_Pre string, P2Score_Pre string, server_point_win boolean, "
    "server_name string, returner_name string, player1_serve_point_win_pct double, player1_return_point_win_pct double, "
    "player2_serve_point_win_pct double, player2_return_point_win_pct double, is_tiebreak boolean, GameWin double, "
    f"best_of_5 double, round double, match_winner string, {_SET_GAMES}"
)
SCORED_LOG = (
    f"{PREPARED_LOG}, points_stake int, p1_points int, p2_points int, p1_win_prob_before double, "
    "p1_win_prob_if_p1_wins double, p1_win_prob_if_p2_wins double, importance double, p1_wp_delta double, "
    "p2_wp_delta double, match_winner_prob_before double"
)
