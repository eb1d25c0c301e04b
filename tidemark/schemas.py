"""Declared schemas of the records that enter from outside."""

PLAYER = "struct<name:string,agent:string,kills:int,fk:int,fd:int,multikills:int,clutches:int>"
ROUND = "struct<number:int,winner:string,win_method:string>"
PAIR = "struct<n:int,won:int>"
ECON = f"struct<fullbuy:{PAIR},lowbuy:{PAIR}>"
MAP = (
    "struct<game_id:string,map_name:string,index:int,team1_score:int,team2_score:int,team1_attack:int,team1_defence:int,"
    f"team2_attack:int,team2_defence:int,rounds:array<{ROUND}>,team1_players:array<{PLAYER}>,team2_players:array<{PLAYER}>,team1_econ:{ECON},team2_econ:{ECON}>"
)
MATCH = (
    "match_id string, start_ts timestamp, status string, best_of int, event string, series string, team1_id string, team1_name string, "
    f"team2_id string, team2_name string, winner string, team1_series_score int, team2_series_score int, veto string, maps array<{MAP}>"
)
CAPTURE = (
    "captured_at timestamp, source string, capture_kind string, market string, line double, book_event_id string, book_home string, book_away string, "
    "book_start_ts timestamp, price_home double, price_away double, match_id string, book_home_is_team1 boolean, link_method string"
)
RAW = "fetched_at timestamp, source string, url string, status int, body string"
#: What tells two captures apart.
CAPTURE_KEY = ("source", "book_event_id", "market", "line", "capture_kind", "captured_at", "match_id")
STATUSES = ("upcoming", "live", "completed")
