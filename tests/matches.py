"""Hand-made points for the state tests."""

DDL = "match_id string, set_no int, game_no int, point_number bigint, point_server int, point_winner int, player1 string, player2 string"


class Log:
    """Collects points game by game."""

    def __init__(self, match_id="2020-usopen-1101"):
        self.match_id, self.rows, self.game_no = match_id, [], 0

    def game(self, set_no, server, winners):
        self.game_no += 1
        for w in winners:
            self.rows.append(
                (self.match_id, set_no, self.game_no, len(self.rows) + 1, server, int(w), "A. One", "B. Two")
            )
        return self

    def frame(self, spark, shuffled=False):
        rows = list(reversed(self.rows)) if shuffled else self.rows
        return spark.createDataFrame(rows, DDL)


def tiebreak_set():
    """Set 1 goes to 6-6 and a tiebreak; set 2 starts, and the log breaks off at 30-15."""
    log = Log()
    for i in range(12):
        log.game(1, 1 + i % 2, "1111" if i % 2 == 0 else "2222")
    log.game(1, 1, "1212121211")
    log.game(2, 2, "1121")
    log.game(2, 1, "112")
    return log
